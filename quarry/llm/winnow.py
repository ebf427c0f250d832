"""Document fingerprints by winnowing, in DataFrame expressions only.

A text is cut into tokens (runs of up to ``TOKEN_CHARS`` code points without white space, lower-cased). Each token is hashed
once; the hash of every ``k`` consecutive tokens is the rolling one by cyclic polynomials (Cohen 1997): the tokens' hashes,
each rotated by its distance from the last, in exclusive or. Of each ``w`` consecutive hashes the smallest is kept, the
rightmost of equal ones. Any passage of ``w + k - 1`` tokens that two texts share leaves them a common hash. Kept hashes carry
the ordinal of their first token, so a match can be located. A run without white space is cut from its start: a passage
shared inside longer runs, as in Chinese, may be cut at other places there, and the guarantee is about tokens, not characters.

Null text counts as empty; a text of fewer than ``k`` tokens has the hash of all of them, an empty one none. Repeated rows
have a row of results each; very long texts are taken whole; extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import only

K, W, TOKEN_CHARS = 4, 4, 8
#: Ranges of ids whose bounds are found from the data; each is then cut evenly into finer ones.
COARSE = 256
#: Bytes of text in a range of ids, and in a task, about; a task sorts its ranges and holds one at a time. The bounds of all
#: ranges are sent to all tasks, so there are at most MOST_RANGES (and as many as COARSE and hot ids add); larger texts have larger ones.
RANGE_BYTES, TASK_BYTES, MOST_TASKS, MOST_RANGES = 4 << 20, 8 << 20, 200_000, 1 << 18
LOWEST = -(2**63)


def _rolled(hashes: str, k: int, n: str) -> tuple[str, list[tuple[str, str]]]:
    """Steps (column, expression) to the hashes of ``k`` consecutive ones of ``hashes``, and the last one's column.

    Hashes of 1, 2, 4, ... tokens are joined as the binary digits of k say; those that begin fewer than k from the end are null.
    """
    steps: list[tuple[str, str]] = []

    def joined(a: str, b: str, size_a: int, size_b: int) -> str:
        name = f"{hashes}_{size_a + size_b}"
        steps.append((name, f"zip_with({a}, slice({b}, {size_a + 1}, {n}), (a, b) -> (shiftleft(a, {size_b}) | shiftrightunsigned(a, {64 - size_b})) ^ b)"))
        return name

    whole, have, power, size = "", 0, hashes, 1
    while True:
        if k & size:
            whole, have = (joined(whole, power, have, size) if have else power), have + size
        if have == k:
            return whole, steps
        power, size = joined(power, power, size, size), 2 * size


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Add ``out``: array<struct<h bigint, p int>>, the kept hashes with the ordinals of their first tokens."""
    t, h, n = f"_{out}_t", f"_{out}_h", f"_{out}_n"
    df = df.withColumn(t, F.expr(rf"transform(regexp_extract_all(lower(coalesce(`{text}`, '')), '\\S{{1,{TOKEN_CHARS}}}', 0), x -> xxhash64(x))"))
    df = df.withColumn(n, F.size(t))
    grams, steps = _rolled(t, k, n)
    for name, e in steps:
        df = df.withColumn(name, F.expr(e))
    short = f"slice(array(aggregate({t}, 0L, (a, x) -> (shiftleft(a, 1) | shiftrightunsigned(a, 63)) ^ x)), 1, least({n}, 1))"
    df = df.withColumn(h, F.expr(f"transform(if({n} < {k}, {short}, slice({grams}, 1, greatest(1, {n} - {k - 1}))), (x, i) -> named_struct('h', x, 'p', -i))"))
    df = df.drop(t, *(name for name, _ in steps))
    # p is negative: of equal hashes the least struct is the rightmost. Minima of 2, 4, ... hashes give those of w;
    # near the end a window is shorter than w, so only full ones (at least one) are kept afterwards.
    have = 1
    df = df.withColumn(n, F.size(h))
    while have < w:
        step = min(have, w - have)
        df = df.withColumn(h, F.expr(f"zip_with({h}, slice({h}, {step + 1}, {n}), (a, b) -> least(a, b))"))
        have += step
    df = df.withColumn(h, F.expr(f"slice({h}, 1, greatest(1, {n} - {w - 1}))")).drop(n)
    kept = f"filter({h}, (x, i) -> i = 0 OR x.p <> {h}[i - 1].p)"
    return df.withColumn(out, F.expr(f"transform({kept}, x -> named_struct('h', x.h, 'p', -x.p))")).drop(h)


def as_text(fp: str) -> Column:
    """``position:hash`` of each kept hash, hexadecimal, separated by spaces."""
    return F.expr(f"array_join(transform({fp}, x -> concat(lower(hex(x.p)), ':', lower(hex(x.h)))), ' ')")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of the sets of kept hashes; 1 if both are empty."""
    sets = f"transform({a}, x -> x.h), transform({b}, x -> x.h)"
    return F.expr(f"if(size({a}) = 0 AND size({b}) = 0, 1D, size(array_intersect({sets})) / cast(size(array_union({sets})) as double))")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, fingerprint of every row's text; equal texts have equal fingerprints."""
    df = with_fingerprint(only(docs, "doc_id", "text"), "text", "_fp", k, w)
    return df.select("doc_id", F.col("_fp").alias("fingerprint"), as_text("_fp").alias("fingerprint_text"))


def _bucketed(docs: DataFrame, ranges: int, bounds: list[int]) -> DataFrame:
    """Rows with their order (_k: the id, null the lowest; _h: of equal ids, from their texts) and the number of their range, which grows with it.

    ``bounds`` are quantiles of the ids: one that stands there more than once is a hot id, whose rows are cut by ``_h``.
    """
    df = only(docs, "doc_id", "text").withColumns({"_k": F.coalesce("doc_id", F.lit(LOWEST)), "_h": F.xxhash64("text")})
    hot = {b for b in bounds if bounds.count(b) > 1 and b < 2**63 - 1}
    at = sorted({*bounds, *(b + 1 for b in hot)})
    fine = max(1, -(-ranges // COARSE))
    sizes = [1] + [fine * (bounds.count(b) if b in hot else 1) for b in at]
    first = [sum(sizes[:i]) for i in range(len(sizes))]
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    df = df.withColumn("_c", F.size(F.filter(longs(at), lambda b: b <= F.col("_k"))))
    lo, hi = F.try_element_at(longs([0, *at]), F.col("_c") + 1), F.try_element_at(longs(at), F.col("_c") + 1)
    size = F.element_at(longs(sizes), F.col("_c") + 1)
    double = lambda c: c.cast("double")  # noqa: E731  # as differences of longs may not fit into one
    by_id = F.try_divide((double(F.col("_k")) - double(lo)) * size, double(hi) - double(lo))
    by_text = (F.col("_h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * size
    part = F.when(F.element_at(F.array(F.lit(False), *[F.lit(b in hot) for b in at]), F.col("_c") + 1), by_text).otherwise(by_id)
    inside = F.least(F.greatest(F.coalesce(part.cast("long"), F.lit(0).cast("long")), F.lit(0)), size - 1)
    return df.withColumn("_b", F.element_at(longs(first), F.col("_c") + 1) + inside).drop("_c")


def edit_likeness(docs: DataFrame, k: int = K, w: int = W, per_partition: int = 8) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next document's are.

    The edited text has the last third of its code points replaced by as many from the start of the next
    document in descending ``doc_id`` (after the last: the first; rows of one id in an order of their texts, null ids last).
    Neighbours meet by one shuffle over ranges of ids, in a window of each range; the first row of the next
    range is added to each as a sentinel, so no range needs another one's rows. Ranges are as many as the bytes of all texts
    ask for, and the rows of a hot id are cut into ranges by their texts; rows of equal id and text stay together.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / COARSE for i in range(COARSE + 1)]
    bounds, size = docs.agg(F.percentile_approx(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), cuts, 10_000), F.sum(F.octet_length("text"))).first()
    df = _bucketed(docs, min(MOST_RANGES, max(per_partition * partitions, (size or 0) // RANGE_BYTES)), bounds or [0, 0])
    tops = df.groupBy("_b").agg(F.max(F.struct("_k", "_h")).alias("_top")).select("_b", "_top.*")  # a row for each range
    by = Window.orderBy("_b")
    goes = F.coalesce(F.lead("_b").over(by), F.min("_b").over(Window.orderBy(F.lit(0))))
    tops = tops.select("_k", "_h", goes.alias("_goes"))
    firsts = df.join(F.broadcast(tops), ["_k", "_h"]).groupBy("_goes", "_k", "_h").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = df.select("_b", F.lit(False).alias("_extra"), "_k", "_h", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    extra = firsts.select(F.col("_goes").alias("_b"), F.lit(True).alias("_extra"), "_k", "_h", F.lit(None).cast("long").alias("doc_id"), "text")
    tasks = max(partitions, min(MOST_TASKS, (size or 0) // TASK_BYTES))
    met = with_fingerprint(rows.unionByName(extra).repartition(tasks, "_b"), "text", "_fp", k, w)
    order = Window.partitionBy("_b").orderBy("_extra", F.col("_k").desc(), F.col("_h").desc(), "text")
    met = met.withColumns({"_next": F.lead("text").over(order), "_next_fp": F.lead("_fp").over(order)}).filter("NOT _extra")
    met = met.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.left("text", (F.col("n_chars") - F.col("_cut")).cast("int")), F.left("_next", F.col("_cut")))
    met = with_fingerprint(met.withColumn("_edited", edited), "_edited", "_edited_fp", k, w)
    return met.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("_fp").alias("fingerprint"), as_text("_edited_fp").alias("edited_fingerprint"),
        likeness("_fp", "_edited_fp").alias("near_edited"), likeness("_fp", "_next_fp").alias("near_next"),
    )
