"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, bucket_of, documents, parallelism, range_bounds

#: A paragraph ends at a line end, behind the marks that end a sentence, or after this many code points.
UNIT = 120
_UNITS = rf"[^\n.!?]{{1,{UNIT}}}+[.!?]*+|[.!?]++"
#: Cells of each of the three parts of the printed sketch, as a power of two.
PRINT_BITS = 2
MOST_BITS = 21
RETRIES = 3
ROUNDS = 9
#: Sketches are sized to this many times the difference that the printed ones hint at (its deviation is some 40 %).
SPARE = 2
_CHECK = 977


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of the text's paragraphs; none for null or empty text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_UNITS), F.lit(0)), lambda u: F.xxhash64(u)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(_CHECK))


def _places(key: Column, bits: Column, attempt: int) -> list[Column]:
    """The key's cell in each of three parts of 2^bits cells."""
    h = F.xxhash64(key, F.lit(attempt))
    side = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    return [(side * j + F.shiftrightunsigned(h, 21 * j).bitwiseAND(side - 1)).cast("int") for j in range(3)]


def sketch(keys: Column) -> Column:
    """The printed sketch of an array of digests: c, n (their number), k (xor of keys), h (xor of check hashes) of 12 cells.

    Sketches are linear, so one set's less another's is that of their difference, each key signed. Each row makes its own
    by lambdas: the aggregate of 36 columns that they replace was a class of 310,000 characters.
    """
    side, zero = 1 << PRINT_BITS, F.lit(0).cast("long")
    at = lambda k, j: F.shiftrightunsigned(F.xxhash64(k, F.lit(0)), 21 * j).bitwiseAND(side - 1)
    marked = F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("h"), *(at(k, j).alias(f"at{j}") for j in range(3))))
    inside = lambda j, i: lambda x: x[f"at{j}"] == i
    own = lambda rows: F.array(*(F.filter(rows, inside(j, i)) for j in range(3) for i in range(side)))
    xor = lambda rows, name: F.aggregate(rows, zero, lambda acc, x: acc.bitwiseXOR(x[name]))
    cell = lambda rows, c: F.struct(c.alias("c"), F.size(rows).cast("long").alias("n"), xor(rows, "k").alias("k"), xor(rows, "h").alias("h"))
    return F.transform(F.array(marked), lambda rows: F.transform(own(rows), cell))[0]  # the outer array binds `marked`, made once


def print_of(size: Column, cells: Column) -> Column:
    """A fingerprint: number of digests, then count, keys and checks of each cell, as hexadecimal digits.

    Depends on the set of digests alone, so equal texts have equal fingerprints; two of them subtract cell by cell.
    """
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")
    one = lambda c: F.concat(digits(c["n"], 8), digits(c["k"], 16), digits(c["h"], 16))
    none = "0" * 40 * (3 << PRINT_BITS)
    return F.lower(F.concat(digits(size, 8), F.coalesce(F.array_join(F.transform(cells, one), ""), F.lit(none))))


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, keys, next_text, next_keys: each row with the one behind it in descending doc_id.

    The row behind the last is the first; a single row is its own next. Null ids come last; rows with one id are in
    order of their texts' hash. Range buckets are windows of their own, and each bucket's first row is also put at the
    end of the bucket before it, so that no window holds more than a bucket.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", 4 * parallelism(spark))
    rows = rows.withColumn("b", bucket_of(F.col("doc_id"), bounds))
    by = Window.orderBy("b")  # over one row a bucket
    tops = rows.groupBy("b").agg(F.max("doc_id").alias("top"))
    tops = tops.select("b", "top", F.coalesce(F.lead("b").over(by), F.min("b").over(Window.partitionBy(F.lit(1)))).alias("dest"))
    placed = (
        rows.join(F.broadcast(tops), "b")
        .withColumn(
            "at",
            F.explode(
                F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.struct(F.col("b"), F.lit(0).alias("halo")), F.struct(F.col("dest").alias("b"), F.lit(1).alias("halo")))).otherwise(
                    F.array(F.struct(F.col("b"), F.lit(0).alias("halo")))
                )
            ),
        )
        .select("at.b", "at.halo", "doc_id", "text")
        .repartition(4 * parallelism(spark), "b")  # texts alone cross the network; their digests are made behind it
        .withColumn("keys", paragraphs(F.col("text")))
    )
    order = Window.partitionBy("b").orderBy("halo", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    following = {"next_text": F.lead("text").over(order), "next_keys": F.lead("keys").over(order)}
    return placed.withColumns(following).filter("halo = 0").select("doc_id", "text", "keys", "next_text", "next_keys")


def _exploded(rows: DataFrame, pairs: dict[int, tuple[str, str]], *more: str) -> DataFrame:
    """rid, pair, s, k, more: a row for each digest of each pair's sets, with s = 1 in the first and -1 in the second."""
    marked = lambda name, pair, sign: F.transform(name, lambda k: F.struct(F.lit(pair).alias("pair"), F.lit(sign).cast("long").alias("s"), k.alias("k")))
    found = F.concat(*(marked(name, pair, sign) for pair, names in pairs.items() for name, sign in zip(names, (1, -1), strict=True)))
    return rows.select("rid", *more, F.explode(found).alias("x")).select("rid", "x.pair", "x.s", "x.k", *more)


def _from_prints(rows: DataFrame, pairs: dict[int, tuple[str, str]]) -> DataFrame:
    """rid, code, c, n, k, h: the cells that differ between the printed sketches of each pair.

    code holds the pair, the sketch's size and a hint of the difference: the differing keys' signs make a cell's count
    a difference of two Poisson counts, so the counts' variance over the cells, times the cells a part, estimates how
    many keys differ, however large the sets are.
    """
    side = 1 << PRINT_BITS
    less = lambda x, y: F.struct(x["c"].alias("c"), (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
    made = rows.select("rid", *(sketch(F.col(name)).alias(name) for name in dict.fromkeys(n for names in pairs.values() for n in names)))
    parts = F.array(*(F.struct(F.lit(pair).alias("pair"), F.zip_with(a, b, less).alias("cells")) for pair, (a, b) in pairs.items()))
    found = made.select("rid", F.explode(parts).alias("x")).select("rid", "x.pair", "x.cells")
    total, square = (F.aggregate("cells", F.lit(0).cast("long"), f) for f in (lambda acc, x: acc + x["n"], lambda acc, x: acc + x["n"] * x["n"]))
    mean = total / (3 * side)
    hint = F.greatest(F.ceil(side * (square / (3 * side) - mean * mean)), F.abs(F.ceil(mean * side)))
    code = F.shiftleft(hint.cast("long"), 8).bitwiseOR((F.col("pair") * 64 + PRINT_BITS).cast("long"))
    cells = found.select("rid", code.alias("code"), F.explode("cells").alias("x")).select("rid", "code", "x.*")
    return cells.filter("n <> 0 or k <> 0 or h <> 0")


def differences(spark: SparkSession, store: Store, rows: DataFrame, pairs: dict[int, tuple[str, str]]) -> DataFrame:
    """rid, pair, delta: sizes of the symmetric differences of two digest sets; pairs without any difference have no row.

    rows: rid and the array columns that pairs name. First the two printed sketches are subtracted and peeled: a cell
    that holds one key gives it away, and taking it out of its other cells frees more. Where that doesn't come out
    whole, sketches sized to the difference that the printed ones hint at are subtracted and peeled; what fails again
    gets four times the cells and another hash each time, and what fails RETRIES times is compared key by key.
    """
    solved, failed = [], None
    sets = list(dict.fromkeys(n for names in pairs.values() for n in names))
    for attempt in range(RETRIES + 1):
        near = rows.select("rid", *sets).repartition(4 * parallelism(spark), "rid")
        if failed is None:
            cells = _from_prints(near, pairs)
        else:
            keyed = _exploded(near.join(failed.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("pair", "hint"))).alias("hints")), "rid"), pairs, "hints")
            goal = F.greatest(F.col("hints")[F.col("pair")] * SPARE, F.lit(6))
            bits = F.least(F.lit(MOST_BITS), F.ceil(F.log2(goal / 1.5)).cast("int") + 2 * (attempt - 1))
            code = F.shiftleft(F.col("hints")[F.col("pair")], 8).bitwiseOR((F.col("pair") * 64 + bits).cast("long"))
            cells = _cells(keyed.filter(F.col("hints")[F.col("pair")].isNotNull()).select("rid", code.alias("code"), "s", "k"), attempt)
        result = store.write(_peel(cells, attempt), f"peel-{attempt}")
        solved.append(result.filter("left = 0").select("rid", "pair", "delta"))
        failed = result.filter("left > 0").select("rid", "pair", "hint")
        if failed.isEmpty():
            return _union(solved)
        if attempt:
            rows = store.write(rows.join(failed.select("rid").distinct(), "rid", "left_semi"), f"again-{attempt}")
    rest = _exploded(rows, pairs).join(failed, ["rid", "pair"], "left_semi").groupBy("rid", "pair", "k").agg(F.sum("s").alias("s"))
    solved.append(rest.groupBy("rid", "pair").agg(F.count_if(F.col("s") != 0).alias("delta")))
    return _union(solved)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _add_up(rows: DataFrame, *group: str) -> DataFrame:
    """Cells of one place added up, without empty ones.

    A filter with a lambda isn't fused with its neighbours, so that each turn of `_peeled` is compiled as a class of its own:
    together they are one of some 750,000 characters, whose compiling takes memory beside the heap.
    """
    x = rows.select(*group, "x.c", "x.n", "x.k", "x.h")
    last = F.exists(F.array("h"), lambda h: h != 0)
    return x.groupBy(*group, "c").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")).filter((F.col("n") != 0) | (F.col("k") != 0) | last)


def _taken(sign: Column, key: Column, bits: Column, attempt: int) -> list[Column]:
    return [F.struct(c.alias("c"), sign.alias("n"), key.alias("k"), _check(key).alias("h")) for c in _places(key, bits, attempt)]


def _cells(keyed: DataFrame, attempt: int) -> DataFrame:
    """rid, code, c, n, k, h: the subtracted sketches' cells that aren't empty, of rows rid, code, s (+1 or -1), k."""
    found = F.array(*_taken(F.col("s"), F.col("k"), F.col("code") % 64, attempt))
    return _add_up(keyed.select("rid", "code", F.explode(found).alias("x")), "rid", "code")


def _peeled(now: DataFrame, attempt: int, keep: bool = False) -> DataFrame:
    """The cells after ROUNDS x 3 turns; rows with c < 0 stand for recovered keys: their number, or (keep) one row each."""
    group = ["rid", "code", "r"] if keep else ["rid", "code"]
    bits = F.col("code") % 64
    side = F.call_function("shiftleft", F.lit(1), bits)
    own, zero = F.struct("c", "n", "k", "h"), F.lit(0).cast("long")
    count = F.struct(F.lit(-1).alias("c"), F.lit(1).cast("long").alias("n"), zero.alias("k"), zero.alias("h"))
    if keep:
        now = now.withColumn("r", F.lit(None).cast("long"))
        count = F.struct(F.lit(-1).alias("c"), F.col("n"), F.col("k"), F.col("h"))
    for turn in range(ROUNDS):
        # In a turn one part of the cells gives its keys: there each key has just one cell, so none is taken twice.
        first = side * (turn % 3)
        pure = (F.col("c") >= first) & (F.col("c") < first + side) & (F.abs("n") == 1) & (F.col("h") == _check(F.col("k")))
        rows = F.when(pure, F.array(own, count, *_taken(-F.col("n"), F.col("k"), bits, attempt))).otherwise(F.array(own))
        now = now.select("rid", "code", *(["r"] if keep else []), F.explode(rows).alias("x"))
        if keep:
            now = now.withColumn("r", F.when(F.col("x.c") < 0, F.col("x.k")))
        now = _add_up(now, *group)
    return now


def _peel(cells: DataFrame, attempt: int) -> DataFrame:
    """rid, pair, hint, delta (keys found), left (cells that stay filled). Rows with one rid lie in one partition."""
    now = _peeled(cells, attempt)
    done = now.groupBy("rid", "code").agg(F.sum(F.when(F.col("c") < 0, F.col("n")).otherwise(0)).alias("delta"), F.count_if(F.col("c") >= 0).alias("left"))
    pair = F.shiftrightunsigned(F.col("code"), 6).bitwiseAND(3).cast("int")
    return done.select("rid", pair.alias("pair"), F.shiftrightunsigned("code", 8).alias("hint"), "delta", "left")


def differing_digests(spark: SparkSession, versions: DataFrame) -> DataFrame:
    """doc_id, side (1: only the old text has the paragraph, -1: only the new one), digest; recovered by peeling.

    versions: doc_id, old, new (texts; null counts as empty; null and repeated doc_ids are rows like any others). Which
    paragraph a digest stands for shows by `paragraphs` of either text. Equal texts and empty tables give no rows; what
    doesn't come out of sketches sized to both sets is compared key by key.
    """
    store, pairs = Store(spark, "iblt-digests"), {0: ("plus", "minus")}
    rows = store.write(versions.select(F.monotonically_increasing_id().alias("rid"), "doc_id", paragraphs(F.col("old")).alias("plus"), paragraphs(F.col("new")).alias("minus")), "sets")
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(PRINT_BITS), F.ceil(F.log2((F.size("plus") + F.size("minus") + 1) / 1.5)).cast("int")))
    sized = rows.repartition(4 * parallelism(spark), "rid").withColumn("code", bits.cast("long"))
    found = store.write(_peeled(_cells(_exploded(sized, pairs, "code"), 1), 1, keep=True), "peeled")
    stuck = found.filter("c >= 0").select("rid").distinct()
    whole = found.filter("c < 0").join(stuck, "rid", "left_anti").select("rid", F.col("n").alias("side"), F.col("k").alias("digest"))
    slow = _exploded(rows.join(stuck, "rid", "left_semi"), pairs).groupBy("rid", "k").agg(F.sum("s").alias("side")).filter("side <> 0").select("rid", "side", F.col("k").alias("digest"))
    return whole.union(slow).join(rows.select("rid", "doc_id"), "rid").select("doc_id", F.col("side").cast("int").alias("side"), "digest")


def likeness(plus: Column, minus: Column, delta: Column) -> Column:
    """Jaccard likeness of two sets of those sizes and that symmetric difference; 1 for two empty ones."""
    both = plus + minus
    return F.when(both == 0, F.lit(1.0)).otherwise((both - delta) / (both + delta))


def fingerprint_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness: Jaccard over the sets they stand for.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's. Null texts are empty; an empty table gives no rows; repeated rows keep a row each; other columns are
    ignored.
    """
    store = Store(spark, "iblt")
    n = F.length("text")
    edited = with_next(spark, docs).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "keys",
        "next_keys",
        F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))")).alias("edited"),
    )
    base = store.write(
        edited.select("doc_id", "n_chars", "keys", "next_keys", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("edited")).alias("edited_keys")).withColumn(
            "rid", F.monotonically_increasing_id()
        ),
        "base",
    )
    pairs = {1: ("keys", "edited_keys"), 2: ("keys", "next_keys")}
    found = differences(spark, store, base, pairs).groupBy("rid").agg(*(F.max(F.when(F.col("pair") == i, F.col("delta"))).alias(f"d{i}") for i in pairs))
    out = base.select("rid", "doc_id", "n_chars", "edited_sha256", "keys", "edited_keys", F.size("next_keys").alias("n_next")).join(found, "rid", "left")
    delta = lambda i: F.coalesce(f"d{i}", F.lit(0))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        print_of(F.size("keys"), sketch(F.col("keys"))).alias("fingerprint"),
        print_of(F.size("edited_keys"), sketch(F.col("edited_keys"))).alias("edited_fingerprint"),
        likeness(F.size("keys"), F.size("edited_keys"), delta(1)).alias("near_edited"),
        likeness(F.size("keys"), F.col("n_next"), delta(2)).alias("near_next"),
    )


def op7_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark, documents(spark, sf_dir))
