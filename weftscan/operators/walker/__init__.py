"""Identifiers, strings, comments and markup text of JavaScript, TypeScript and TSX."""
