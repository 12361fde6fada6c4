"""Secret scans that link the parts of multipart credentials.

Strong parts (assignments to secret names, cloud access ids, long hex runs) are always reported. Weak
parts (a client or user id, a bare token, an endpoint) mean little alone: they are joined by interval
with the other parts within a scope of code points, and reported only where complementary parts stand
in that scope. A scope never leaves a document, so the join is made inside the row, as a sweep over the
parts in order of place each way, carrying the nearest access part and secret seen so far: no shuffle, no
pairs, and the cost is that of sorting the parts. Only Spark's own functions are used.

Places are found by splitting the text at the matches: the lengths of gaps and matches add up to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,kind:int>"
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "id", "value", "endpoint")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs: the same as all runs of which the short ones are dropped
WEAK_ID = r"""(?i:access_?key(?:_?id)?|client_?id|user_?name|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
WEAK_VALUE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WEAK_ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|(?i:endpoint|hostname|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_./:-]{4,}"""


#: A query parameter's value: it is a part of its own inside an endpoint, which other bare values are not.
WEAK_PARAMETER = r"(?<==)[A-Za-z0-9+/_-]{20,}={0,2}"
_PARAMETER = 6  # while scanning; told as a value
_PIECE = 256


def _none(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def _scan(items: Column, state: dict[str, Column], kind: str, step) -> Column:
    """The array of what `step(state, item)` gives for each item in turn: (next state, element, whether to keep it).

    Elements are gathered in pieces of bounded size, so that the cost of appending stays linear.
    """
    names = list(state)
    start = F.struct(*[v.alias(k) for k, v in state.items()], _none(kind).alias("piece"), _none(f"array<{kind}>").alias("done"))

    def advance(acc: Column, item: Column) -> Column:
        then, element, keep = step(acc, item)
        full = F.size(acc["piece"]) >= _PIECE
        piece = F.when(full, _none(kind)).otherwise(acc["piece"])
        done = F.when(full, F.array_append(acc["done"], acc["piece"])).otherwise(acc["done"])
        return F.struct(*[then[k].alias(k) for k in names], F.when(keep, F.array_append(piece, element)).otherwise(piece).alias("piece"), done.alias("done"))

    return F.aggregate(items, start, advance, lambda acc: F.flatten(F.array_append(acc["done"], acc["piece"])))


def _spans(text: Column, pattern: str, kind: int, at_least: int = 0, group: int = 0) -> Column:
    """The leftmost non-overlapping matches whose group has at_least characters, as spans in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if group else F.transform(matches, F.char_length)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(matches, F.char_length).alias("size"), sizes.alias("kept"))

    def step(acc: Column, p: Column):
        begin = acc["at"] + p["gap"]
        span = F.struct(begin.alias("start"), (begin + p["size"]).alias("end"), F.lit(kind).alias("kind"))
        return {"at": begin + F.coalesce(p["size"], F.lit(0))}, span, F.coalesce(p["kept"] >= at_least, F.lit(False))

    return F.when(F.rlike(text, F.lit(pattern)), _scan(parts, {"at": F.lit(0)}, SPAN, step)).otherwise(_none())


def _flagged(parts: Column, marks: dict[str, tuple[int, ...]], reach: int) -> Column:
    """Each part with a flag per mark: whether a part of one of the mark's kinds is less than `reach` code
    points away, 0 being side by side and less than that an overlap, one inside the other too.

    Two sweeps in order of start: forwards with the last end of the parts so far, then backwards with the
    first start of those that follow. Every other part is before or after in that order, so none is missed.
    """
    kind = f"struct<start:int,end:int,kind:int,{','.join(f'{m}:boolean' for m in marks)}>"
    plain = lambda p: [p[k].alias(k) for k in ("start", "end", "kind")]

    def ahead(acc: Column, p: Column):
        flags = [(p["start"] - acc[m] < reach).alias(m) for m in marks]
        return {m: F.when(p["kind"].isin(*kinds), F.greatest(acc[m], p["end"])).otherwise(acc[m]) for m, kinds in marks.items()}, F.struct(*plain(p), *flags), F.lit(True)

    def back(acc: Column, p: Column):
        flags = [(p[m] | (acc[m] - p["end"] < reach)).alias(m) for m in marks]
        return {m: F.when(p["kind"].isin(*kinds), F.least(acc[m], p["start"])).otherwise(acc[m]) for m, kinds in marks.items()}, F.struct(*plain(p), *flags), F.lit(True)

    forwards = _scan(F.array_sort(parts), {m: F.lit(-(1 << 30)) for m in marks}, kind, ahead)
    return _scan(F.reverse(forwards), {m: F.lit(1 << 30) for m in marks}, kind, back)


def scan_secrets(docs: DataFrame, scope: int = 240, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep` and `found`: array of (start, end, kind index) of all spans; `base`: those of strong parts.

    A bare value or a secret counts as a secret, an access id or a named id as an access part. A weak id
    is reported with a secret in its scope, a weak value with an access part, an endpoint with both; parts
    that lie in one another are in scope. Weak values that touch a strong or named part or lie in an
    endpoint are that part and not reported again, but an endpoint's parameters are values of their own.
    Null text is empty; one row per row, repeated or not; other columns are ignored.
    """
    t = F.col("_t")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"), *keep)
    rows = rows.withColumn("_assign", _spans(t, ASSIGN, 0, 6, 2)).withColumn("_access", _spans(t, ACCESS, 1, 20)).withColumn("_hex", _spans(t, HEX, 2, 24)).withColumn("_id", _spans(t, WEAK_ID, 3))
    rows = rows.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    linkable = (F.size("_id") > 0) | (F.size("_access") > 0)  # every link has an access part
    weak = {"_value": (WEAK_VALUE, 4), "_endpoint": (WEAK_ENDPOINT, 5), "_parameter": (WEAK_PARAMETER, _PARAMETER)}
    rows = rows.withColumns({c: F.when(linkable, _spans(t, pattern, kind)).otherwise(_none()) for c, (pattern, kind) in weak.items()})
    rows = rows.withColumn("_all", F.when(linkable, F.concat("base", "_id", *weak)).otherwise(_none()))
    rows = rows.withColumn("_touched", _flagged(F.col("_all"), {"named": (0, 1, 2, 3), "point": (5,), "access": (1,)}, 0))
    own = lambda p: F.when(p["kind"] == 3, ~p["access"]).when(p["kind"] == 4, ~p["named"] & ~p["point"]).when(p["kind"] == _PARAMETER, ~p["named"]).otherwise(True)
    told = lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.when(p["kind"] == _PARAMETER, 4).otherwise(p["kind"]).alias("kind"))
    rows = rows.withColumn("_parts", F.array_distinct(F.transform(F.filter("_touched", own), told)))
    rows = rows.withColumn("_near", _flagged(F.col("_parts"), {"a": (1, 3), "s": (0, 2, 4)}, scope + 1))
    linked = lambda p: F.when(p["kind"] == 3, p["s"]).when(p["kind"] == 4, p["a"]).when(p["kind"] == 5, p["a"] & p["s"]).otherwise(False)
    found = F.array_sort(F.concat(F.col("base"), F.transform(F.filter("_near", linked), told)))
    return rows.withColumn("found", F.when(F.size("_near") > 0, found).otherwise(F.col("base"))).select("doc_id", *keep, "base", "found")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda p: p["kind"] == kind)).cast("long")


def mask_spans(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [kind]; of spans that overlap, the first that starts, longest
    first, gives the name, and all they cover goes. Null text stays null; without spans, text is as it was."""
    ordered = F.array_sort(F.transform(spans, lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("less"), p["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = -p["less"]
        name = F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), p["kind"] + 1), F.lit("]"))
        before = F.substring(text, acc["at"] + 1, p["start"] - acc["at"])
        out = F.when(p["start"] >= acc["at"], F.concat(acc["out"], F.array(before, name))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], end).alias("at"), out.alias("out"))

    joined = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span in order of start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ",")


def secret_digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak parts that were reported)."""
    return scanned.select(
        "doc_id",
        _count("base", 0).alias("n_assign"),
        _count("base", 1).alias("n_access"),
        _count("base", 2).alias("n_hex"),
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_linked"),
    )
