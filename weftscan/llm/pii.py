"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base spans (e-mail, IP, card, phone) and long mixed hexadecimal strings are the seed entities. Every token, and every
run of tokens that hold a digit, is an instance; the words around it are its lexical patterns. Seeds give patterns their precision
over distinct instances, patterns above a bar give instances a score, and accepted instances feed the next round, all
as grouped aggregates over the pattern-instance graph. What the last round accepts, in a context that is itself a
strong pattern, adds spans; base spans always stay.

Positions come from pairing what a pattern matches with what splitting by it leaves, so texts are read whole and in
the JVM. Patterns are possessive, or anchored at the start of a run, so that their time is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.regex_scan import starts
from .store import fits_broadcast, join_shuffled, join_sized, table

KINDS = ["email", "ip", "card", "phone"]
SEED = "secret"
#: A run may start where the character before is none of its own, or where the match before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What stands for the characters of a base span, those of a token, and the units of a text.
MASK = "\ue000"
_LETTERS, _OF = r"[\p{L}\p{M}._%+@-]", r"[\p{L}\p{N}\p{M}._%+@-]"
_RUN = rf"(?:\x20{_LETTERS}*+\p{{N}}{_OF}*+){{0,9}}+"
UNIT = rf"{MASK}++|{_LETTERS}++(?:\p{{N}}{_OF}*+{_RUN})?+|\p{{N}}{_OF}*+{_RUN}|[^\p{{L}}\p{{N}}\p{{M}}._%+@\s\"'{MASK}-]++"
SECRET = r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{32,64}$"
ROUNDS = 3
#: A pattern is strong with this precision over distinct instances and this much seed weight; an instance is accepted at this score.
PRECISION, SUPPORT, ACCEPT = 0.8, 3.0, 0.85
#: An instance stands in strong patterns at this share of its places at least: else it is a common word that came there.
SHARE = 0.5
#: Patterns are tried on one of so many texts before they are tried on all.
PARTS = [64, 8]
#: So many keys, of so many bytes, may stand in a plan, where units are chosen before there are rows of them; more are joined.
LISTED, LISTED_BYTES = 2000, 256 << 10
#: How units are stored: their dictionaries are large, and pages pack well.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20)}
#: Code points of a block: what finding a place in a text costs at most.
BLOCK = 1024


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        v = digits.substr(F.length(digits) - k + 1, F.lit(1)).cast("int")
        doubled = v * 2 - F.when(v > 4, 9).otherwise(0)
        return total + F.when(k % 2 == 0, doubled).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)(?:\.|$)){4}$") & ~m.rlike(r"^\.|\.\.|\.$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _gate(kind: str, text: Column) -> Column:
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}[kind]


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, m>> of the leftmost non-overlapping matches, in code points; linear in text and matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(x: Column) -> Column:
        steps = F.zip_with(x["m"], F.slice(x["g"], F.lit(1), F.size(x["m"])), lambda m, g: F.length(m) + F.length(g))
        one = lambda m, k, sums: let(F.get(sums, k) + F.length(F.get(x["g"], k)), lambda at: F.struct(at.alias("start"), (at + F.length(m)).alias("stop"), m.alias("m")))
        return let(starts(steps), lambda sums: F.transform(x["m"], lambda m, k: one(m, k, sums)))

    return let(F.struct(found.alias("m"), gaps.alias("g")), placed)


SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"
RUN, VALUED = "array<struct<start:int,stop:int,kind:string>>", "array<struct<start:int,stop:int,kind:string,value:string>>"


def base_spans(text: Column) -> Column:
    """Sorted base spans of a text (start, rank of the kind, kind, stop)."""
    parts = []
    for rank, kind in enumerate(KINDS):
        valid = partial(_valid, kind)
        good = F.filter(_located(text, PATTERNS[kind]), lambda s: valid(s["m"]))  # noqa: B023
        spans = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))  # noqa: B023
        parts.append(F.when(_gate(kind, text), spans.cast(SPAN)).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _cut(text: Column) -> Column:
    """The text in blocks of BLOCK code points, in which a place is found without walking the whole text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _between(blocks: Column, start: Column, stop: Column) -> Column:
    """The code points from start to stop of a text that :func:`_cut` has cut."""

    def piece(x: Column) -> Column:
        i, j, a, b = x["i"], x["j"], x["a"], x["b"]
        inner = F.when(j - i > 1, F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")).otherwise("")
        far = F.concat(F.get(blocks, i).substr(a + 1, F.lit(BLOCK)), inner, F.coalesce(F.get(blocks, j).substr(F.lit(1), b), F.lit("")))
        return F.when(stop <= start, F.lit("")).when(i == j, F.get(blocks, i).substr(a + 1, stop - start)).otherwise(far)

    at = lambda v: F.floor(v / BLOCK).cast("int")
    return let(F.struct(at(start).alias("i"), at(stop).alias("j"), (start % BLOCK).alias("a"), (stop % BLOCK).alias("b")), piece)


def _highest(xs: Column) -> Column:
    """Exclusive running maxima of an array of counts, -1 before the first; block by block, so that their cost stays linear."""
    grow = lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x)))
    running = lambda part, low: F.slice(F.aggregate(part, F.array(low), grow), 1, F.size(part))

    def levelled(parts: Column) -> Column:
        tops = F.transform(parts, F.array_max)
        return let(running(tops, F.lit(-1)), lambda lows: F.flatten(F.transform(parts, lambda part, k: running(part, F.get(lows, k)))))

    def cut(ys: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(ys) - 1) / 128).cast("int")), lambda k: F.slice(ys, k * 128 + 1, F.lit(128)))
        return F.when(F.size(ys) <= 128, running(ys, F.lit(-1))).otherwise(let(parts, levelled))

    return let(xs, cut)


def _merged(found: Column, touching: bool) -> Column:
    """array<struct<start, stop, kind>>: runs of sorted spans that overlap (or touch), each with the kind of its first."""

    def merge(spans: Column) -> Column:
        stops = F.transform(spans, lambda s: s["stop"])
        level = F.transform(F.arrays_zip(spans.alias("s"), _highest(stops).alias("p")), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["p"].alias("p")))
        heads = F.filter(level, lambda x: x["start"] > x["p"] if touching else x["start"] >= x["p"])
        return let(heads, lambda hs: F.transform(hs, lambda h, k: F.struct(h["start"].alias("start"), F.coalesce(F.get(hs, k + 1)["p"], F.array_max(stops)).alias("stop"), h["kind"].alias("kind"))))

    return let(found, merge)


def _replaced(text: Column, runs: Column, by: Callable[[Column], Column]) -> Column:
    """The text with what each of some disjoint sorted runs covers replaced by ``by`` of the run."""

    def build(x: Column) -> Column:
        blocks, rs = x["blocks"], x["runs"]
        before = lambda r, k: _between(blocks, F.coalesce(F.get(rs, k - 1)["stop"], F.lit(0)), r["start"])
        tail = _between(blocks, F.element_at(rs, -1)["stop"], F.length(text))
        return F.concat(F.array_join(F.transform(rs, lambda r, k: F.concat(before(r, k), by(r))), ""), tail)

    return F.when(F.size(runs) == 0, text).otherwise(let(F.struct(_cut(text).alias("blocks"), runs.alias("runs")), build))


def _masked(text: Column, runs: Column) -> Column:
    """The text with every character of a base span turned into MASK: of the same length, and each run of spans one unit."""
    clean = F.when(text.contains(MASK), F.translate(text, MASK, " ")).otherwise(text)
    return _replaced(clean, runs, lambda r: F.repeat(F.lit(MASK), r["stop"] - r["start"]))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, F.col("doc_id").cast("long").alias("id"), F.xxhash64(_text()).alias("th"), _text().alias("t"))


def _with_runs(texts: DataFrame) -> DataFrame:
    """Add base, runs and the masked text to texts ``t``."""
    found = texts.withColumn("base", base_spans(F.col("t")))
    merged = found.withColumn("runs", F.when(F.size("base") > 0, _merged(F.col("base"), True)).otherwise(F.array().cast(RUN)))
    return merged.withColumn("masked", _masked(F.col("t"), F.col("runs")))


def prepared(docs: DataFrame, row: Column) -> DataFrame:
    """Stored: row, id, th, base, runs, secret, values, words of every whole text; a null counts as empty.

    ``row`` is what of a document travels along. A unit is a run of touching base spans, a run of tokens that hold a digit,
    any other token, or punctuation. ``values`` are the units as they stand without trailing marks, MASK for base spans
    and empty for punctuation; ``words`` are hashes of what units are in a context. ``runs`` are the base spans as
    units, with what they cover.
    """
    masked = _with_runs(_keyed(docs, row.alias("row")))
    value = lambda cut, r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"), r["kind"].alias("kind"), _between(cut, r["start"], r["stop"]).alias("value"))
    runs = F.when(F.size("runs") > 0, let(_cut(F.col("t")), lambda cut: F.transform("runs", lambda r: value(cut, r)))).otherwise(F.array().cast(VALUED))
    held = lambda v: F.when(v.startswith(MASK), F.lit(MASK)).when(v.rlike(r"[\p{L}\p{N}]"), F.rtrim(v, F.lit("._%+@-"))).otherwise("")
    plain = F.regexp_replace(F.regexp_replace(F.lower("masked"), "[0-9]++", "9"), f"{MASK}++", MASK)
    units = lambda text: F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    each = masked.select(
        "row", "id", "th", "base", runs.alias("runs"), F.col("masked").rlike("[0-9a-fA-F]{32}").alias("secret"),
        F.transform(units("masked"), held).alias("values"), F.transform(units(plain), lambda w: F.xxhash64(w)).alias("words"),
    )
    return table(each, "units", **PACKED)


#: The low bits of a pattern are those of the word before, so that most units need no hash to be told apart from some patterns.
LOW = (1 << 16) - 1


def _low(w: Column) -> Column:
    return F.coalesce(w.bitwiseAND(F.lit(LOW).cast("long")), F.lit(0).cast("long"))


def _slots(w2: Column, w1: Column, r1: Column) -> tuple[Column, Column]:
    """The lexical patterns of a unit, hashed: two words before; one word before and one after."""
    hashed = lambda *parts: F.shiftleft(F.xxhash64(*parts), 16).bitwiseOR(_low(w1))
    return hashed(F.lit(1), w2, w1).alias("left"), hashed(F.lit(2), w1, r1).alias("both")


def _places(units: DataFrame, wanted: Callable[[Column, Column, tuple[Column, Column]], Column] | None = None) -> DataFrame:
    """id, th, k, value, left, both: every unit that is no base span and holds a letter or a digit, with its patterns.

    With ``wanted``, a condition on the value, the word before and both patterns, other units are left out before there
    are rows of them.
    """
    word = lambda k: F.get("words", k)
    slots = lambda k: _slots(word(k - 2), word(k - 1), word(k + 1))

    def chosen(v: Column, k: Column) -> Column:
        ok = (v != "") & (v != MASK)
        return F.when(ok if wanted is None else ok & wanted(v, word(k - 1), slots(k)), k)

    at = F.filter(F.transform("values", chosen), F.isnotnull)
    rows = F.transform(at, lambda k: F.struct(k.alias("k"), F.get("values", k).alias("value"), *slots(k)))
    return units.select("id", "th", F.inline(rows))


def _listed(keys: DataFrame) -> list | None:
    """The values of a stored table of one column, if they are few enough to stand in a plan."""
    return [r[0] for r in keys.collect()] if fits_broadcast(keys, LISTED, LISTED_BYTES) else None


def _of_values(units: DataFrame, keys: DataFrame) -> DataFrame:
    """The places of some values: ``keys`` is a stored table (value, ...)."""
    few = _listed(keys.select("value"))
    wanted = None if few is None else lambda v, before, slots: v.isin(few)
    return join_sized(_places(units, wanted), keys, ["value"], nulls=False)


def _of_patterns(units: DataFrame, keys: DataFrame) -> DataFrame:
    """value, pattern of the places of some patterns: ``keys`` is a stored table (pattern)."""
    few, wanted = _listed(keys), None
    if few is not None:
        lows = sorted({p & LOW for p in few})
        wanted = lambda v, before, slots: _low(before).isin(lows) & (slots[0].isin(few) | slots[1].isin(few))
    return join_sized(_spread(_places(units, wanted), few), keys, ["pattern"], nulls=False).select("value", "pattern")


def _spread(places: DataFrame, few: list | None = None) -> DataFrame:
    """value, pattern: both patterns of every place, or those of them that are among a few."""
    both = F.array("left", "both")
    return places.select("value", F.explode(both if few is None else F.filter(both, lambda p: p.isin(few))).alias("pattern"))


def _seeds(units: DataFrame) -> DataFrame:
    """id, th, k, value, kind, left, both of every base span and every secret."""
    at = F.filter(F.transform("values", lambda v, k: F.when(v == MASK, k)), F.isnotnull)

    def own(x: Column) -> Column:
        word = lambda d: F.get("words", x["k"] + d)
        return F.struct(x["k"].alias("k"), x["s"]["value"].alias("value"), x["s"]["kind"].alias("kind"), *_slots(word(-2), word(-1), word(1)))

    spans = units.where(F.size("runs") > 0).select("id", "th", F.inline(F.transform(F.arrays_zip(at.alias("k"), F.col("runs").alias("s")), own)))
    secrets = _places(units.where("secret"), lambda v, before, slots: v.rlike(SECRET)).withColumn("kind", F.lit(SEED))
    return spans.unionByName(secrets)


def _promising(units: DataFrame, likely: DataFrame) -> DataFrame:
    """Stored: those of the patterns (pattern, s) that can still be precise enough.

    A pattern holds at least as many values in all texts as in some, so what too many values share in a part of the
    texts is left out before larger parts are read for it. No pattern is lost that would be strong.
    """
    for part in PARTS:
        some = _of_patterns(units.where(F.pmod(F.col("th"), F.lit(part)) == 0), likely.select("pattern"))
        held = some.distinct().groupBy("pattern").agg(F.count("*").alias("n"))
        kept = join_shuffled(likely, held, "pattern", "left").where(F.col("s") >= PRECISION * F.coalesce("n", F.lit(0)))
        likely = table(kept.select("pattern", "s"), "likely")
    return likely.select("pattern")


def discover(docs: DataFrame, units: DataFrame) -> DataFrame:
    """id, th, extra: the spans that the bootstrapping adds, for texts that get some; ``units`` is what :func:`prepared` gives for ``docs``.

    Units are read anew for the slots of patterns that seeds could make strong, and for the places of what is accepted;
    rows are made of those units alone that are asked for.
    """
    found = table(_seeds(units), "instances")
    scored = seeds = found.groupBy("value").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("score"))
    edges = _spread(found).distinct()
    asked, strong, accepted, around = None, None, None, None
    for _ in range(ROUNDS):
        likely = join_shuffled(edges, scored, "value").groupBy("pattern").agg(F.sum("score").alias("s")).where(F.col("s") >= SUPPORT)
        new = _promising(units, table(likely if asked is None else join_shuffled(likely, asked, "pattern", "left_anti"), "likely"))
        asked = new if asked is None else asked.unionByName(new)
        if not new.isEmpty():
            edges = table(edges.unionByName(_of_patterns(units, new)).distinct(), "edges")
        weighed = join_shuffled(join_shuffled(edges, asked, "pattern"), scored, "value", "left")
        patterns = weighed.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.coalesce("score", F.lit(0.0))).alias("s"), F.mode("kind", True).alias("kind"))
        strong = table(patterns.where((F.col("s") >= SUPPORT) & (F.col("s") >= PRECISION * F.col("n"))).select("pattern", "kind", (F.col("s") / (F.col("n") + 0.1)).alias("precision")), "patterns")
        miss = F.sum(F.log(1 - F.least("precision", F.lit(0.99))))
        reached = join_sized(edges, strong, ["pattern"], nulls=False).groupBy("value").agg(F.max_by("kind", F.struct("precision", "kind")).alias("kind"), (1 - F.exp(miss)).alias("score"))
        fresh = table(join_shuffled(reached.where(F.col("score") >= ACCEPT), seeds, "value", "left_anti").select("value", "kind", "score"), "fresh")
        if fresh.isEmpty():
            accepted = None
            break
        # places stay as they are, so only those of values that no round has asked for are read
        unseen = fresh.select("value") if around is None else table(join_shuffled(fresh.select("value"), around.select("value"), "value", "left_anti"), "unseen")
        if around is None or not unseen.isEmpty():
            more = table(_of_values(units, unseen).groupBy("value", "left", "both").count(), "around")
            around = more if around is None else around.unionByName(more)
        ways = join_shuffled(around, fresh.select("value"), "value", "left_semi").select("value", "count", F.inline(F.array(F.struct(F.lit(True).alias("is_left"), F.col("left").alias("pattern")), F.struct(F.lit(False).alias("is_left"), F.col("both").alias("pattern")))))
        ok = F.col("ok").isNotNull()
        sums = [F.sum(F.when(c, F.col("count")).otherwise(0)) for c in (F.col("is_left") & ok, ~F.col("is_left") & ok, F.col("is_left"))]
        held_in = join_shuffled(ways, strong.select("pattern", F.lit(True).alias("ok")), "pattern", "left").groupBy("value").agg((F.greatest(sums[0], sums[1]) / sums[2]).alias("share"))
        accepted = table(join_shuffled(fresh, held_in.where(F.col("share") >= SHARE).select("value"), "value"), "accepted")
        edges = edges.unionByName(join_shuffled(ways, accepted, "value", "left_semi").select("value", "pattern")).distinct()
        scored = seeds.unionByName(accepted)
    spots = found.where(F.col("kind") == SEED).select("id", "th", "k", "value", "kind")
    if accepted is not None and not accepted.isEmpty():
        near = _of_values(units, accepted.select("value", "kind"))
        spoken = join_sized(near.select("id", "th", "k", "value", "kind", F.explode(F.array("left", "both")).alias("pattern")), strong.select("pattern"), ["pattern"], nulls=False)
        spots = spots.unionByName(spoken.select("id", "th", "k", "value", "kind"))
    one = F.struct("k", F.length("value").alias("n"), "kind")
    spots = table(spots.groupBy("id", "th").agg(F.collect_set(one).alias("spots")), "spots")
    texts = _with_runs(join_sized(_keyed(docs), spots, ["id", "th"])).select("id", "th", "spots", "masked")
    cuts = texts.withColumn("cuts", F.transform(F.split("masked", UNIT, -1), F.length)).withColumn("units", F.regexp_extract_all("masked", F.lit(UNIT), F.lit(0)))
    steps = cuts.withColumn("sums", starts(F.zip_with(F.slice("cuts", F.lit(1), F.size("units")), "units", lambda g, v: g + F.length(v))))

    def span(z: Column, s: Column) -> Column:
        return let(F.get(z["sums"], s["k"]) + F.get(z["cuts"], s["k"]), lambda at: F.struct(at.alias("start"), F.lit(len(KINDS)).alias("rank"), F.concat(F.lit("context_"), s["kind"]).alias("kind"), (at + s["n"]).alias("stop")))

    extra = let(F.struct("sums", "cuts"), lambda z: F.transform("spots", lambda s: span(z, s)))
    return steps.select("id", "th", extra.cast(SPAN).alias("extra")).dropDuplicates(["id", "th"])


def _found(docs: DataFrame, row: Column) -> DataFrame:
    """row, id, th, base, extra of every row of ``docs``."""
    units = prepared(docs, row)
    extra = table(discover(docs, units), "extra")
    return join_sized(units.select("row", "id", "th", "base"), extra, ["id", "th"], "left").withColumn("extra", F.coalesce("extra", F.array().cast(SPAN)))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, base, extra for every row of ``docs`` (doc_id, text; other columns are not read).

    Null and empty texts have no spans. Repeated rows, and rows whose doc_id is null, get the spans of their own text.
    Spans that start together are ordered by kind as listed, those of the method last.
    """
    return _found(docs.select("doc_id", "text"), F.struct("doc_id")).select(F.col("id").alias("doc_id"), "th", "base", "extra")


def _all(base: Column | str = "base", extra: Column | str = "extra") -> Column:
    return F.array_sort(F.concat(base, extra))


def redact(text: Column, found: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by the name of its first kind in angle brackets."""
    named = lambda r: F.concat(F.lit("<"), F.upper(r["kind"]), F.lit(">"))
    return F.when(F.size(found) == 0, text).otherwise(_replaced(text, _merged(found, False), named))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars, where there is one, follows.

    Nulls in any column stay, repeated rows are all kept, and columns may have any names: they travel inside ``row``.
    """
    rows = _found(docs, F.struct("*")).withColumn("found", _all())
    out = rows.withColumn("clean", F.when(F.col("row.text").isNotNull(), redact(F.col("row.text").cast("string"), F.col("found"))))
    change = {"text": F.col("clean").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return out.select(*[change.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256")
    return rows.select("doc_id", *[count(k) for k in KINDS], digest, joined_spans(_all()).alias("spans"), F.size("extra").cast("long").alias("n_context"))


