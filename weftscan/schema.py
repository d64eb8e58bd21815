"""Record types: source files in, segments out."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("filename", T.StringType()),
    T.StructField("file_type", T.StringType()), T.StructField("content", T.StringType()),
])

#: Offsets count code points, so ``substring(content, start + 1, end - start)`` is the segment's source.
SEGMENT = T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("raw_text", T.StringType()),
    T.StructField("map", T.ArrayType(T.IntegerType())), T.StructField("tags", T.ArrayType(T.StringType())),
])
SEGMENTS = T.ArrayType(SEGMENT)
SEGMENTS_DDL = "array<struct<pos:int,start:int,end:int,text:string,raw_text:string,map:array<int>,tags:array<string>>>"
