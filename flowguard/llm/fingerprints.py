"""SimHash fingerprints of documents, with DataFrame functions alone.

Every occurrence of a term votes with the term's weight on each of the 64 bits of its hash. The 64 vote counters lie in 32
long columns, two 32-bit lanes each, so all votes of a text are one aggregation of plain sums. Fingerprints within a
Hamming radius are found by permuted block tables: of any two such fingerprints some choice of blocks agrees exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, small

BITS = 64
_LANES = 0x0000000100000001
_SPACES = "[\\x20\\x09-\\x0D]+"


def terms(text: Column) -> Column:
    """The words of a text in lower case; a leading or trailing empty one is left in."""
    return F.split(F.lower(text), _SPACES)


def _weight(term: Column) -> Column:
    """Short words are mostly grammar and say little: 0 for no characters, 1 up to three, 3 up to six, else 5."""
    n = F.length(term)
    return F.when(n == 0, 0).when(n <= 3, 1).when(n <= 6, 3).otherwise(5).cast("long")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., n_rows, fingerprint): the SimHash, a long, of each text. keys name a text; rows equal in them have equal texts and are counted in n_rows.

    A null text counts as empty. A text without terms has the fingerprint 0. Bits whose votes are tied are 0.
    """
    rows = texts.select(*keys, F.posexplode(terms(F.coalesce(F.col(text), F.lit("")))).alias("_at", "_term"))
    rows = rows.select(*keys, "_at", _weight(F.col("_term")).alias("_w"), F.xxhash64("_term").alias("_h"))
    lanes = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(_LANES) * F.col("_w")).alias(f"_v{i}") for i in range(BITS // 2)]
    votes = rows.groupBy(*keys).agg(F.count_if(F.col("_at") == 0).alias("n_rows"), F.sum("_w").alias("_all"), *lanes)
    # Once for each text, so an interpreted fold will do; as one expression it would be a very large method.
    counters = F.array(*[F.col(f"_v{i}") for i in range(BITS // 2)])
    low = F.transform(counters, lambda v: (v.bitwiseAND(0xFFFFFFFF) * 2 > F.col("_all")).cast("long"))
    high = F.transform(counters, lambda v: (F.shiftrightunsigned(v, 32) * 2 > F.col("_all")).cast("long"))
    # Bits from the highest to the lowest; doubling by addition of equal parts would overflow, a shift doesn't.
    out = F.aggregate(F.reverse(F.concat(low, high)), F.lit(0).cast("long"), lambda x, bit: F.shiftleft(x, 1).bitwiseOR(bit))
    return votes.select(*keys, "n_rows", out.alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def _blocks(radius: int, blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    whole = [sum(chosen) for chosen in combinations(masks, blocks - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in whole]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, fingerprint, distance): for each distinct fingerprint of queries all distinct ones of index within the radius, itself included.

    The 64 bits are cut into blocks; radius differing bits leave blocks - radius of them whole, so one of the tables, each
    of which permutes one choice of so many blocks to the front, brings every pair together. Both frames have a column
    fingerprint; nulls find nothing. Equal fingerprints are one row: callers keep what belongs to each.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(_blocks(radius, blocks))])

    def filed(frame: DataFrame) -> DataFrame:
        distinct = frame.where("fingerprint is not null").select("fingerprint").distinct()
        return distinct.select("fingerprint", F.explode(tables).alias("x")).select("fingerprint", "x.table", "x.key")

    asked = filed(queries).withColumnRenamed("fingerprint", "query")
    found = asked.join(filed(index), ["table", "key"])
    return found.select("query", "fingerprint", distance(F.col("query"), F.col("fingerprint")).alias("distance")).where(F.col("distance") <= radius).distinct()


def _placed(rows: DataFrame, bits: int, tables: list[DataFrame], most_cells: int) -> DataFrame:
    """rows (doc_id, u, ...) with their cell (start, part) and shift, the bits that its ids differ in; -1 for a cell that is cut by u."""
    first = F.col("doc_id").bitwiseAND(F.lit(-(1 << bits)).cast("long"))
    rows = rows.select("*", first.alias("start"), F.lit(0).cast("long").alias("part"), F.lit(bits).alias("shift"))
    kept = [c for c in rows.columns if c not in ("start", "part", "shift")]
    for table in tables:
        finer = small(table, 4 * most_cells).select(F.col("start").alias("s"), F.col("part").alias("p"), "by_id", "to")
        rows = rows.join(finer, F.col("start").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")), "left")
        by_id, by_hash = F.coalesce("by_id", F.lit(False)), F.coalesce(~F.col("by_id"), F.lit(False))
        rows = rows.select(
            *kept,
            F.when(by_id, F.expr("doc_id & shiftleft(-1L, to)")).otherwise(F.col("start")).alias("start"),
            F.when(by_hash, F.expr("shiftright(u, to)")).otherwise(F.col("part")).alias("part"),
            F.when(by_id, F.col("to")).when(by_hash, -1).otherwise(F.col("shift")).alias("shift"),
        )
    return rows


def _cells(keys: DataFrame, rows_per_cell: int, most_cells: int) -> tuple[int, list[DataFrame]]:
    """How _placed() is to cut keys (doc_id, u) into cells of at most about four times rows_per_cell rows.

    Cells are ranges of ids that start at multiples of a power of two. Full ones are cut into finer ranges, full single
    ids and the null ids by leading bits of the texts' hash u, until none is full but of equal texts. So gaps and
    clusters of ids don't matter. Each round counts once more, reading keys alone; dense ids need one.
    """
    low, high, count = keys.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    rows_per_cell = max(rows_per_cell, -(-count // most_cells))
    width = 0 if low is None else (high - low + 1) // max(1, count // rows_per_cell)
    bits, tables = max(0, min(62, width.bit_length() - 1)), []
    while True:
        counts = _placed(keys, bits, tables, most_cells).groupBy("start", "part", "shift").agg(F.count("*").alias("k"), F.min("u").alias("low"), F.max("u").alias("high"))
        ids = F.col("start").isNotNull() & (F.col("shift") > 0)
        full = counts.where((F.col("k") > 4 * rows_per_cell) & (F.col("shift") >= 0) & (ids | (F.col("low") < F.col("high"))))
        finer = F.greatest(F.lit(1), F.ceil(F.log2(F.col("k") / rows_per_cell)).cast("int"))
        cut = materialize(full.select("start", "part", ids.alias("by_id"), F.when(ids, F.greatest(F.lit(0), F.col("shift") - finer)).otherwise(63 - finer).alias("to")))
        if not cut.limit(1).count():
            return bits, tables
        tables.append(cut)


def with_next(documents: DataFrame, rows_per_cell: int = 2000, most_cells: int = 65536) -> DataFrame:
    """documents (doc_id, text) with next_id and next_text: the next document's by ascending doc_id, the first one's for the last.

    Rows go to cells by id (see _cells), about rows_per_cell rows each. The first row of a cell also goes to the cell
    before it, so each cell finds the successors of its rows by itself and texts move once. Cell bounds, a few times
    most_cells small rows at most, are all that is seen as a whole. A null doc_id sorts first; equal ids are ordered by
    their text's hash, then text. A single row is its own successor.
    """
    u = F.shiftrightunsigned(F.xxhash64("text"), 1).alias("u")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", u, "text")
    bits, tables = _cells(rows.select("doc_id", "u"), rows_per_cell, most_cells)
    placed = _placed(rows, bits, tables, most_cells)
    firsts = placed.select("start", "part", "doc_id", "u").groupBy("start", "part").agg(F.min(F.struct("doc_id", "u")).alias("f")).collect()
    firsts.sort(key=lambda r: (r["start"] is not None, r["start"] or 0, r["part"]))
    spark = documents.sparkSession
    guests = [(r["start"], r["part"], r["f"]["doc_id"], r["f"]["u"], before["start"], before["part"]) for before, r in zip(firsts[-1:] + firsts[:-1], firsts)]
    guests = spark.createDataFrame(guests, "s long, p long, first_id long, first_u long, to_start long, to_part long")
    home = F.struct(F.lit(0).alias("guest"), "start", "part")
    away = F.struct(F.lit(1).alias("guest"), F.col("to_start").alias("start"), F.col("to_part").alias("part"))
    leads = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("u") == F.col("first_u"))
    every = placed.join(small(guests, 4 * most_cells), F.col("start").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    every = every.select("doc_id", "u", "text", F.explode(F.when(leads, F.array(home, away)).otherwise(F.array(home))).alias("h")).select("doc_id", "u", "text", "h.*")
    w = W.partitionBy("start", "part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "u", "text")
    found = every.select("doc_id", "text", "guest", F.lead("doc_id").over(w).alias("next_id"), F.lead("text").over(w).alias("next_text"))
    return found.where("guest = 0").drop("guest")


def edited(text: Column, other: Column) -> Column:
    """A text whose last floor(n/2) code points are replaced by the first as many, or all, of another one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_report(documents: DataFrame, radius: int = 3) -> DataFrame:
    """One row for each row of documents (doc_id, text, ...): its fingerprint, its edited text's, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (16 hex digits), near_edited, near_next
    (likeness to the edited text and to the next document), n_near: for documents whose doc_id is divisible by 20 the
    number of rows of all documents whose fingerprints lie within the radius, its own row included; else null.

    A null text counts as empty. Order, ties and repeated rows: see with_next. Equal texts have equal fingerprints.
    Extra columns are not read. An empty table gives none.
    """
    rows = with_next(documents)
    new = edited(F.col("text"), F.col("next_text"))
    base = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(new, 256).alias("edited_sha256"),
        F.md5("text").alias("t"), "next_id", F.md5("next_text").alias("next_t"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), new.alias("text")))).alias("x"),
    ).select("*", "x.which", "x.text").drop("x")
    keys = ["doc_id", "t", "n_chars", "edited_sha256", "next_id", "next_t"]
    signed = fingerprints(base, [*keys, "which"])
    signed = signed.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"),
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("f"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("e"),
    )
    signed = materialize(signed)
    of_next = signed.groupBy(F.col("doc_id").alias("next_id"), F.col("t").alias("next_t")).agg(F.max("f").alias("g"))
    own, nxt = signed.alias("s"), of_next.alias("n")
    full = own.join(nxt, F.col("s.next_id").eqNullSafe(F.col("n.next_id")) & (F.col("s.next_t") == F.col("n.next_t")), "left")
    counts = signed.groupBy(F.col("f").alias("fingerprint")).agg(F.sum("n_rows").alias("rows"))
    asked = signed.where(F.col("doc_id") % 20 == 0)
    near = within_radius(asked.select(F.col("f").alias("fingerprint")), counts, radius).join(counts, "fingerprint")
    near = near.groupBy("query").agg(F.sum("rows").alias("n_near"))
    wide = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    full = full.select("s.*", "n.g").join(near, F.when(F.col("doc_id") % 20 == 0, F.col("f")) == F.col("query"), "left")
    return full.select(
        "doc_id", "n_chars", "edited_sha256", wide(F.col("f")).alias("fingerprint"), wide(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("g")).alias("near_next"), "n_near",
        F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))).alias("row"),
    ).drop("row")
