"""Document fingerprints as invertible Bloom lookup tables, in SQL functions only.

A text's paragraphs (its lines, a long one cut at sentence ends) are hashed to
64-bit digests.  A table has three rows of cells; each distinct digest is added
to one cell of each row: the cell counts its digests and keeps the exclusive or
of them and of their check hashes.  Tables of two versions subtract cell by
cell, so what both have vanishes, and peeling recovers the rest: a cell with
one digest gives it up, it leaves its other cells, and so on.

The fingerprint is a table of three rows of eight cells.  If the difference of
two fingerprints doesn't peel, the pair retries with a table that is wide
enough for all its digests, and then with ever wider ones under other hashes,
until all are recovered.  Likeness is Dice's:
twice the shared digests over the sum of both counts.

The next document in descending order of ids is found in range buckets of the
order, each of which also gets the first document of the bucket after it, so the
order never passes through one task.  Bucket bounds are (id, text's hash), so
rows of one id, and those without an id, are many buckets too; the bounds alone
come from a sample of about ``BOUNDS`` rows by hash.

Defined results: null text is empty; texts without paragraphs are alike (1) and
unlike all others (0); rows of one id follow each other in the order of their
texts' hashes; null ids come last; a single row is its own next one; ids may be
of any type with an order; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settle, table

ROWS = 3
WIDTH = 8
#: Rounds of peeling a fingerprint, and sweeps over the rows of a wide table; what is left then is retried.
ROUNDS = 6
SWEEPS = 2
#: Characters from which a line is cut at its next sentence end.
LONG = 150
#: Rows that bucket bounds are chosen from.
BOUNDS = 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with its argument computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    units = F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{{LONG},}}?[.!?](?=\s)|[^\n]+"), F.lit(0)), lambda u: F.trim(u)), lambda u: u != "")
    return F.array_distinct(F.transform(units, lambda u: F.xxhash64(u)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(ROWS))


def _mask(digest: Column) -> Column:
    """The digest's cells, one of each row, as bits."""
    bits = [F.call_function("shiftleft", F.lit(1 << WIDTH * r), F.shiftrightunsigned(digest, 32 + 8 * r).bitwiseAND(F.lit(WIDTH - 1)).cast("int")) for r in range(ROWS)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _item(digest: Column, n: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), digest.alias("key"), _check(digest).alias("check"), _mask(digest).alias("mask"))


def _add(cell: Column, item: Column, sign: int) -> Column:
    n = cell["n"] + item["n"] if sign > 0 else cell["n"] - item["n"]
    return F.struct(n.alias("n"), cell["key"].bitwiseXOR(item["key"]).alias("key"), cell["check"].bitwiseXOR(item["check"]).alias("check"), cell["bit"].alias("bit"))


def block(found: Column) -> Column:
    """The cells of a set of digests; ``bit`` is a cell's place."""
    none = F.expr("array(" + ", ".join(f"named_struct('n', 0, 'key', 0L, 'check', 0L, 'bit', {1 << i})" for i in range(ROWS * WIDTH)) + ")")

    def cells(items: Column) -> Column:
        return F.transform(none, lambda cell: F.aggregate(F.filter(items, lambda x: x["mask"].bitwiseAND(cell["bit"]) != 0), cell, lambda c, x: _add(c, x, 1)))

    return let(F.transform(found, lambda d: _item(d, F.lit(1))), cells)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check"), x["bit"].alias("bit")))


def peel(cells: Column) -> Column:
    """(left, right, ok): digests of the one side and the other, and whether these are all."""
    pure = lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"])
    start = F.struct(cells.alias("cells"), F.expr("cast(array() as array<bigint>)").alias("left"), F.expr("cast(array() as array<bigint>)").alias("right"))

    def step(state: Column, _: Column) -> Column:
        def remove(found: Column) -> Column:
            side = lambda n: F.transform(F.filter(found, lambda p: p["n"] == n), lambda p: p["key"])
            left = F.transform(state["cells"], lambda c: F.aggregate(F.filter(found, lambda p: p["mask"].bitwiseAND(c["bit"]) != 0), c, lambda c, p: _add(c, p, -1)))
            return F.when(F.size(found) == 0, state).otherwise(F.struct(left.alias("cells"), F.concat(state["left"], side(1)).alias("left"), F.concat(state["right"], side(-1)).alias("right")))

        return let(F.array_distinct(F.transform(F.filter(state["cells"], pure), lambda c: _item(c["key"], c["n"]))), remove)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return let(done, lambda s: F.struct(s["left"], s["right"], F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0)).alias("ok")))


def recover(pairs: DataFrame, growth: int = 1) -> DataFrame:
    """pairs (pid, a, b) of sets of digests -> pid, left, right, open: how many digests each side alone has, and cells that don't peel.

    One large table for each pair, its cells as rows; empty cells are no rows,
    so a wide table costs nothing.  Peeling goes row by row of the table: in
    one row a digest has one cell, so none is removed twice.  All rounds run
    where the pair is: one shuffle of the sets, by pid, and none of cells.
    """
    spark = pairs.sparkSession
    check = lambda key: F.xxhash64(key, F.lit(ROWS))
    cell = lambda key, r: F.lit(r) * F.col("width") + F.xxhash64(key, F.lit(growth * ROWS + r)).bitwiseAND(F.col("width") - 1)
    entry = lambda at, n, key, sum_: F.struct(at.alias("cell"), n.alias("n"), key.alias("key"), sum_.alias("check"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def together(rows: DataFrame) -> DataFrame:
        cells = rows.groupBy("pid", "width", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
        return cells.filter("n <> 0 or key <> 0 or check <> 0")

    width = F.greatest(F.lit(32).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * growth * (F.size("a") + F.size("b"))))).cast("long"))
    signed = F.concat(F.transform("a", lambda d: F.struct(one.alias("n"), d.alias("key"))), F.transform("b", lambda d: F.struct((-one).alias("n"), d.alias("key"))))
    dealt = pairs.select("pid", "a", "b").filter(F.size("a") + F.size("b") > 0).repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "pid")
    items = dealt.select("pid", width.alias("width"), F.explode(signed).alias("i")).select("pid", "width", "i.*")
    rows = items.select("pid", "width", F.explode(F.array(*[entry(cell(F.col("key"), r), F.col("n"), F.col("key"), check(F.col("key"))) for r in range(ROWS)])).alias("e")).select("pid", "width", "e.*")
    cells = together(rows)
    for turn in range(SWEEPS * ROWS):
        r = turn % ROWS
        pure = F.col("cell").between(r * F.col("width"), (r + 1) * F.col("width") - 1) & (F.abs("n") == 1) & (F.col("check") == check(F.col("key")))
        taken = entry(F.when(F.col("n") > 0, F.lit(-1)).otherwise(F.lit(-2)).cast("long"), one, zero, zero)
        gone = [entry(cell(F.col("key"), q), -F.col("n"), F.col("key"), F.col("check")) for q in range(ROWS) if q != r]
        same = entry(F.col("cell"), F.col("n"), F.col("key"), F.col("check"))
        cells = together(cells.select("pid", "width", F.explode(F.when(pure, F.array(taken, *gone)).otherwise(F.array(same))).alias("e")).select("pid", "width", "e.*"))
    return cells.groupBy("pid").agg(F.coalesce(F.sum(F.when(F.col("cell") == -1, F.col("n"))), zero).alias("left"), F.coalesce(F.sum(F.when(F.col("cell") == -2, F.col("n"))), zero).alias("right"), F.count_if(F.col("cell") >= 0).alias("open"))


def written(cells: Column) -> Column:
    """A table as a string."""
    return F.array_join(F.transform(cells, lambda c: F.concat(c["n"].cast("string"), F.lit(":"), F.lower(F.hex(c["key"])), F.lit(":"), F.lower(F.hex(c["check"])))), ",")


def _below(x: Column, cuts: list[Column]) -> Column:
    """How many of the sorted cuts are less than x: every so many first, then those between."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    block = F.size(F.filter(F.array(*cuts[::step]), lambda c: c < x)) - 1
    inside = F.size(F.filter(F.slice(F.array(*cuts), F.greatest(block, F.lit(0)) * step + 1, F.lit(step)), lambda c: c < x))
    return F.when(block < 0, 0).otherwise(block * step + inside)


def with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text, next_text: that of the following row in descending order of ids; after the last comes the first."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "tie")
    every = max(1, rows.count() // BOUNDS)
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(every)) == 0).select(place.alias("p")).distinct().orderBy("p").select("p.*").collect()
    cuts = [chosen[i * len(chosen) // buckets] for i in range(1, buckets)] if chosen else []
    cuts = [F.struct(F.lit(named).alias("named"), F.lit(doc_id).cast(kind).alias("doc_id"), F.lit(tie).cast("long").alias("tie")) for named, doc_id, tie in dict.fromkeys(map(tuple, cuts))]
    rows = rows.withColumn("bucket", _below(place, cuts))
    firsts = rows.groupBy("bucket").agg(F.max(place).alias("first")).orderBy("bucket").collect()  # one row per bucket
    after = [(r["bucket"], firsts[i - 1]["first"]["doc_id"], firsts[i - 1]["first"]["tie"]) for i, r in enumerate(firsts)]  # the lowest bucket is followed by the highest
    heads = spark.createDataFrame(after, T.StructType().add("into", T.IntegerType()).add("head", kind).add("head_tie", T.LongType()))
    ghosts = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie"))).select("doc_id", "text", "tie", F.col("into").alias("bucket"), F.lit(True).alias("ghost"))
    line = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    return both.select("doc_id", "text", "ghost", F.lead("text").over(line).alias("next_text")).filter(~F.col("ghost")).drop("ghost")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, digests, fingerprint of each text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), digests(F.coalesce(F.col(text_col), F.lit(""))).alias("digests"))
    return rows.select("doc_id", "digests", written(block(F.col("digests"))).alias("fingerprint"))


def compare(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name the likeness of two columns of digests; the columns of digests give way to their fingerprints.

    Fingerprints are subtracted and peeled first; pairs that differ by more
    than they hold go to ``recover``, and again with wider tables until all are
    recovered.
    """
    sides = sorted({c for ab in pairs.values() for c in ab})
    rest = [c for c in rows.columns if c not in sides]
    names = list(pairs)
    small = lambda n: F.when(F.col(f"{n}_peeled.ok"), F.size(f"{n}_peeled.left") + F.size(f"{n}_peeled.right")).cast("long")
    first = rows.withColumn("rid", F.monotonically_increasing_id()).select("*", *[block(F.col(c)).alias(f"{c}_cells") for c in sides])
    first = first.select("rid", *rest, *sides, *[written(F.col(f"{c}_cells")).alias(f"{c}_fingerprint") for c in sides], *[peel(minus(F.col(f"{a}_cells"), F.col(f"{b}_cells"))).alias(f"{n}_peeled") for n, (a, b) in pairs.items()])
    first = settle(first.select("rid", *rest, *sides, *[f"{c}_fingerprint" for c in sides], *[small(n).alias(n) for n in names]), "iblt")
    waiting = None
    for i, (n, (a, b)) in enumerate(pairs.items()):
        part = first.filter(F.col(n).isNull()).select((F.col("rid") * len(names) + i).alias("pid"), F.col(a).alias("a"), F.col(b).alias("b"))
        waiting = part if waiting is None else waiting.unionByName(part)
    found, growth = [], 1
    while True:
        done = settle(recover(waiting, growth), "iblt-recovered")
        found.append(done.filter("open = 0").select("pid", (F.col("left") + F.col("right")).alias("differ")))
        stuck = done.filter("open > 0").select("pid")
        if stuck.isEmpty():
            break
        waiting, growth = settle(waiting.join(stuck, "pid", "left_semi"), "iblt-retry"), growth * 2
    all_ = found[0]
    for part in found[1:]:
        all_ = all_.unionByName(part)
    which = F.pmod("pid", F.lit(len(names)))
    by_row = all_.groupBy(F.floor(F.col("pid") / len(names)).cast("long").alias("rid")).agg(*[F.max(F.when(which == i, F.col("differ"))).alias(f"{n}_differ") for i, n in enumerate(names)])
    like = []
    for n, (a, b) in pairs.items():
        total = F.col(f"{a}_n") + F.col(f"{b}_n")
        like.append(F.when(total == 0, F.lit(1.0)).otherwise((total - F.coalesce(n, f"{n}_differ", F.lit(0).cast("long"))) / total).alias(n))
    kept = first.select("rid", *rest, *[f"{c}_fingerprint" for c in sides], *[F.size(c).alias(f"{c}_n") for c in sides], *names)
    return kept.join(by_row, "rid", "left").select(*rest, *[f"{c}_fingerprint" for c in sides], *like)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("edited", edited)
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), digests(F.col("next_text")).alias("following"),
    )
    found = compare(rows, {"near_edited": ("own", "changed"), "near_next": ("own", "following")})
    return found.select("doc_id", "n_chars", "edited_sha256", F.col("own_fingerprint").alias("fingerprint"), F.col("changed_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
