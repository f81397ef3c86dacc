"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A sketch is linear: entering a digest adds it to three cells, so the sketch of one version minus
that of another holds just the digests in which they differ. Peeling then takes the digests out
of the cells that hold a single one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jabcheck.llm.common import bucketed, release, shuffles_deleted, staged, storing

#: A published fingerprint has 2 to the power of this cells in each of its three tables.
PUBLISHED = 3
#: A sketch that is subtracted has at least so many cells in each of its three tables.
LEAST = 16
#: Rounds of peeling; in round r the pure cells of table r mod 3 give up their digest.
ROUNDS = 6
#: Documents of a run, which is a range of the id order sorted by one task. Buckets take runs by
#: a hash, so of thousands some hold six or seven, which must be peeled in the memory of a task.
RUN = 500
#: Runs share buckets beyond this number, as Spark tables have 100,000 buckets at most.
MOST_BUCKETS = 50_000
#: Levels of the difference estimate; level j sees one digest in 8 to the power of j.
LEVELS = 4

#: Where a paragraph ends: after a line feed, after the end of a sentence, and after a word by its
#: last two letters, about one word in five, so texts without sentences are cut as well.
_ODD = r"acegikmoqsuwyACEGIKMOQSUWY13579\u0100-\uffff"
_LAST = r"dhlptxDHLPTX048\u03b1-\u03b4\u0430-\u0433\u05d0-\u05d4\u0621-\u0628"
ENDS = rf"(?<=[\s\u3002\uff01\uff1f])(?<=\n|[.!?]\s|[\u3002\uff01\uff1f]|[{_ODD}][{_LAST}]\s)"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order; together they are the text.

    Where one ends depends on the few characters before that place, whatever the length of the
    text and the distance from its start. So what two texts share is cut alike in both, and
    longer texts have more paragraphs.
    """
    return F.filter(F.split(text, ENDS), lambda p: p != "")


def digests(text: Column) -> Column:
    """The distinct 48-bit digests of the paragraphs."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p).bitwiseAND(F.lit(KEY))))


#: Bits of a digest; a word is a digest with a check of 16 bits above it.
KEY = (1 << 48) - 1


def _word(key: Column) -> Column:
    """A digest and its check, 16 bits of a second hash, in one number.

    The hashes of digests have 64 bits, in which no two digests are equal for every table.
    """
    return key.bitwiseOR(F.shiftleft(F.xxhash64(key, F.lit(7)), 48))


# --- how far two sets differ, before their sketches are sized


def strata(keys: Column) -> Column:
    """For each level the bits that an odd number of the sampled digests has set, as 64-bit words.

    Words of two sets combine by XOR to those of their difference.
    """

    def word(level: int) -> Column:
        sampled = keys
        if level:
            sampled = F.filter(keys, lambda k: k.bitwiseAND(F.lit((1 << 3 * level) - 1)) == 0)
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(k, 40).bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(sampled, F.lit(0).cast("bigint"), lambda a, k: a.bitwiseXOR(bit(k)))

    return F.array(*[word(level) for level in range(LEVELS)])


def estimated(left: Column, right: Column, most: Column) -> Column:
    """About how many digests are in one set only, from the strata of both.

    The first level with few odd bits is read; where all are full it is ``most``.
    """
    guess = most.cast("double")
    for level in reversed(range(LEVELS)):
        odd = F.bit_count(left[level].bitwiseXOR(right[level]))
        guess = F.when(odd <= 24, -32.0 * F.log(1 - odd / 32.0) * 8.0**level).otherwise(guess)
    return F.least(guess, most.cast("double"))


# --- sketches, subtracted and peeled


def _cell(key: Column, table: Column, bits: Column, salt: int) -> Column:
    """The number of the cell that a digest falls in: size and table in the high bits, then the place.

    A table has 2 to the power of ``bits`` cells.
    """
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)
    place = F.xxhash64(key, table + 3 * salt).bitwiseAND(size - 1)
    return F.shiftleft((bits * 4 + table).cast("bigint"), 32) + place


def _folded(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The cells: entries that fall together are added up, and empty cells go."""
    cells = rows.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.bit_xor("word").alias("word"))
    return cells.filter("n <> 0 or word <> 0")


def peeled(pairs: DataFrame, by: Sequence[str], left: str, right: str, salt: int = 0, lists: bool = True) -> DataFrame:
    """``by``, ``cell``, ``n``, ``word`` of the digests in which two arrays differ, and of cells that remain.

    ``pairs`` has the binary logarithm of the cells of a table as ``bits``. A digest is entered
    in a cell of each table: 1 is added to the number, or -1 where it comes from ``right``, and
    its word by XOR, so what both hold cancels out. A round looks at one table, where a digest
    has one cell: a cell with a single digest and a matching check gives it up, and the digest
    leaves its other cells. With ``lists`` what was recovered is a row with a negative cell of
    its own, the digest in ``word``, and ``n`` 1 where it is in ``left`` only, -1 where in
    ``right`` only. Without, it is counted in the ``n`` of cell -1. Rows are grouped by pair
    throughout, so where pairs are dealt by a part of ``by`` nothing moves.
    """
    sides = F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("keys")) for c, n in ((left, 1), (right, -1))])
    rows = pairs.select(*by, "bits", F.explode(sides).alias("side"))
    rows = rows.select(*by, "bits", F.col("side.n").alias("n"), F.explode("side.keys").alias("key"))
    rows = rows.select(*by, "bits", "n", "key", F.explode(F.array(*map(F.lit, range(3)))).alias("table"))
    n, key, table = F.col("n"), F.col("word").bitwiseAND(F.lit(KEY)), F.col("table")
    cells = _folded(rows.select(*by, _cell(F.col("key"), table, F.col("bits"), salt).alias("cell"), "n", _word(F.col("key")).alias("word")), by)
    bits = F.shiftright("cell", 34).bitwiseAND(F.lit(31)).cast("int")
    keep, give = -1, -2
    for r in range(ROUNDS):
        number = r % 3
        pure = (F.abs(n) == 1) & (_word(key) == F.col("word")) & (F.col("cell") == _cell(key, F.lit(number), bits, salt))
        out = [F.lit(give), *[F.lit(t) for t in range(3) if t != number]]
        rows = cells.select(*by, "cell", "n", "word", F.explode(F.when(pure, F.array(*out)).otherwise(F.array(F.lit(keep)))).alias("table"))
        kept, found = table == keep, table == give
        rows = rows.select(
            *by,
            F.when(kept, F.col("cell")).when(found, -1 - key if lists else F.lit(-1)).otherwise(_cell(key, table, bits, salt)).alias("cell"),
            F.when(kept, n).when(found, n if lists else F.lit(1)).otherwise(-n).alias("n"),
            F.when(found, key if lists else F.lit(0)).otherwise(F.col("word")).alias("word"),
        )
        cells = _folded(rows, by)
    return cells


def differences(
    pairs: DataFrame, by: Sequence[str], left: str, right: str, lists: bool = True, buckets: int | None = None
) -> DataFrame:
    """``by`` and ``changes`` for each pair of arrays of distinct digests that differ, written to the shared folder.

    With ``lists`` also ``left_only`` and ``right_only``, the recovered digests themselves in
    ascending order. ``by`` must name one row. The first sketch of a pair has six to
    twelve cells for each difference that its strata let expect; pairs that do not peel are tried
    again with four times as many cells and other hashes, until all are solved. Pairs without
    any difference have no row.

    With ``buckets`` the pairs are dealt to so many buckets by the first column of ``by``, in
    which none is NULL. What is still open is then looked up bucket by bucket: no try moves an
    array.
    """
    guess = estimated(strata(F.col(left)), strata(F.col(right)), F.size(left) + F.size(right))
    bits = F.ceil(F.log2(F.greatest(guess * 2, F.lit(float(LEAST))))).cast("int")
    pairs = pairs.select(*by, left, right)
    recovered, n = F.col("cell") < 0, F.col("n")
    number = F.when(recovered, F.abs("n")).otherwise(0)
    told = [F.sum(number).alias("changes"), F.bool_or(~recovered).alias("open")]
    if lists:
        for name, sign in (("left_only", 1), ("right_only", -1)):
            told.append(F.sort_array(F.collect_list(F.when(recovered & (n == sign), F.col("word")))).alias(name))
    done, salt, todo = [], 0, pairs
    while True:
        cells = peeled(todo.withColumn("bits", bits + 2 * salt), by, left, right, salt, lists)
        tried = cells.groupBy(*by).agg(*told)
        tried = bucketed(tried, by[0], buckets=buckets) if buckets else staged(tried)
        done.append(tried.filter("not open").drop("open"))
        again = tried.filter("open").select(*by)
        if again.isEmpty():
            return reduce(DataFrame.unionByName, done)
        salt += 1
        if buckets:
            todo = _among(pairs, again, by)
        else:
            same = reduce(Column.__and__, [F.col(f"p.{c}").eqNullSafe(F.col(f"again.{c}")) for c in by])
            todo = pairs.alias("p").join(again.alias("again"), same, "left_semi")


def _among(pairs: DataFrame, names: DataFrame, by: Sequence[str]) -> DataFrame:
    """The pairs that ``names`` has, where both are dealt by the first column of ``by``.

    A join by all columns would deal both anew, arrays and all.
    """
    named = names.groupBy(F.col(by[0]).alias("_dealt")).agg(F.collect_list(F.struct(*by)).alias("_named"))
    found = pairs.join(named, F.col(by[0]) == F.col("_dealt")).filter(F.array_contains("_named", F.struct(*by)))
    return found.select(*pairs.columns)


# --- the published fingerprint


def sketches(rows: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``by`` and, under each name of an array of digests, the text of its sketch of fixed size.

    For each cell in use it has 24 hexadecimal letters: 2 for the table and place, 6 for the
    number, 16 for the XOR of words. Where all arrays of a row are empty there is no row.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("keys")) for i, c in enumerate(names)])
    keys = rows.select(*by, F.explode(sides).alias("x")).select(*by, "x.side", F.explode("x.keys").alias("key"))
    keys = keys.select(*by, "side", "key", F.explode(F.array(*map(F.lit, range(3)))).alias("table"))
    cell = _cell(F.col("key"), F.col("table"), F.lit(PUBLISHED), 0)
    cells = _folded(keys.select(*by, "side", cell.alias("cell"), F.lit(1).alias("n"), _word(F.col("key")).alias("word")), (*by, "side"))
    table, place = F.shiftright("cell", 32).bitwiseAND(F.lit(3)), F.col("cell").bitwiseAND(F.lit((1 << PUBLISHED) - 1))
    letters = F.concat(
        F.lpad(F.hex((table * (1 << PUBLISHED) + place).cast("bigint")), 2, "0"),
        F.lpad(F.hex("n"), 6, "0"),
        F.lpad(F.hex("word"), 16, "0"),
    )
    lists = [F.collect_list(F.when(F.col("side") == i, letters)) for i in range(len(names))]
    return cells.groupBy(*by).agg(*[F.lower(F.array_join(F.sort_array(c), "")).alias(n) for c, n in zip(lists, names)])


# --- each text beside the next one


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """``run, place, last, after, doc_id, text, next_text``, each text beside that of the next id, and the number of runs.

    After the last row comes the first again, so a single row is its own next. NULL ids come
    first; rows with one id are ordered by a hash of their text. NULL texts are empty.

    Range partitioning on id, hash and a row number cuts the order into runs of about ``RUN``
    rows, so neither NULL nor a repeated id is one task's. Runs are stored as a table dealt by
    run, with the place of each row; the files by which they were sorted go.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    runs = -(-docs.count() // RUN) or 1
    order = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    ranged = rows.repartitionByRange(runs, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.select(F.spark_partition_id().alias("run"), place.alias("place"), "doc_id", "text")
    with shuffles_deleted(docs.sparkSession):
        kept = _by_run(ranged, runs)
    ends = kept.groupBy("run").agg(F.max("place").alias("last"))
    by_run = Window.orderBy("run")  # one short row for each run
    after = F.coalesce(F.lead("run").over(by_run), F.min("run").over(Window.partitionBy()))
    ends = staged(ends.select("run", "last", after.alias("after")))
    return beside(kept.join(ends, "run"), "text", "next_text"), runs


def _buckets(runs: int) -> int:
    return min(runs, MOST_BUCKETS)


def _by_run(rows: DataFrame, runs: int) -> DataFrame:
    """``rows``, stored so that each run lies in one bucket."""
    return bucketed(rows, "run", buckets=_buckets(runs), compression="zstd")


def beside(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the value of ``column`` in the following row as ``name``.

    That is the next row of the run, and for its last row the first of the run ``after``.
    Rows that are dealt by run stay where they are.
    """
    first = rows.filter("place = 0").select(F.col("run").alias("after"), F.col(column).alias("first"))
    ends = rows.filter("place = 0").select("run", "after").join(first, "after").select("run", "first")
    following = F.lead(column).over(Window.partitionBy("run").orderBy("place"))
    found = rows.withColumn("following", following).join(staged(ends), "run")
    value = F.when(F.col("place") == F.col("last"), F.col("first")).otherwise(F.col("following"))
    return found.withColumn(name, value).drop("following", "first")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of an edited version, and two likenesses.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text has its last quarter replaced by the start of the next
    document. A fingerprint is the number of digests and their sketch, a function of the text
    alone; equal texts have equal ones. Likeness is the share of paragraph digests in common,
    ``(all - changes) / (all + changes)``, where the changes are the digests recovered from
    the difference of two sketches. NULL texts count as empty; two empty texts have likeness
    1. Extra columns are ignored.

    The stored texts are deleted as soon as their digests are stored.
    """
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    texts = f"texts-{uuid.uuid4().hex}"
    with storing(texts):
        rows, runs = with_next(docs)
    told = rows.withColumn("edited", edited).select(
        "run",
        "place",
        "last",
        "after",
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("fingerprint"),
        digests(F.col("edited")).alias("edited_fingerprint"),
    )
    told = _by_run(told, runs)
    release(docs.sparkSession, texts)
    sets = beside(told, "fingerprint", "next_fingerprint")
    others = ("edited_fingerprint", "next_fingerprint")
    pairs = sets.select(
        "run",
        F.explode(
            F.array(
                *[
                    F.struct((F.col("place") * 2 + which).alias("pair"), F.col("fingerprint").alias("left"), F.col(other).alias("right"))
                    for which, other in enumerate(others)
                ]
            )
        ).alias("x"),
    ).select("run", "x.*")
    solved = differences(pairs, ("run", "pair"), "left", "right", lists=False, buckets=_buckets(runs))
    changes = solved.select("run", F.shiftright("pair", 1).alias("place"), (F.col("pair") % 2).alias("which"), "changes")
    changes = changes.groupBy("run", "place").agg(
        *[F.coalesce(F.max(F.when(F.col("which") == which, F.col("changes"))), F.lit(0)).alias(other) for which, other in enumerate(others)]
    )
    texts = sketches(told, ("run", "place"), ("fingerprint", "edited_fingerprint"))
    rows = sets.select(
        "run",
        "place",
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.size("fingerprint").alias("n"),
        *[F.size(other).alias(f"n_{other}") for other in others],
    )
    rows = rows.alias("r").join(changes.alias("c"), ["run", "place"], "left").join(texts.alias("t"), ["run", "place"], "left")

    def near(other: str) -> Column:
        total, change = F.col("n") + F.col(f"n_{other}"), F.coalesce(F.col(f"c.{other}"), F.lit(0))
        return F.when(total == 0, 1.0).otherwise((total - change) / (total + change)).cast("double")

    def text(name: str, n: str) -> Column:
        return F.concat(F.col(n).cast("string"), F.lit(":"), F.coalesce(F.col(f"t.{name}"), F.lit("")))

    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text("fingerprint", "n").alias("fingerprint"),
        text("edited_fingerprint", "n_edited_fingerprint").alias("edited_fingerprint"),
        near("edited_fingerprint").alias("near_edited"),
        near("next_fingerprint").alias("near_next"),
    )
