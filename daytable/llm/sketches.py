"""Document fingerprints that tell which paragraphs differ: invertible Bloom lookup sketches, as columns of arrays.

A text's paragraphs are its lines, long ones cut into sentences; their digests go to three cells each, one in each third of a table, and a
cell holds their number, the xor of the digests and the xor of a check of each. Tables of two texts subtract cell by cell:
what both have is gone, and a cell that holds one digest gives it up (its check says so), is taken out of the other two,
and so on until the table is empty. A table that stays full was too small for the difference: it is tried again with others
of twice the cells, over parts of the digests, so that a long text's difference is many small tables.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytable.llm.common import SPACE, cut, or_empty, table

#: Cells in a third of a fingerprint and of the first table of a part; digests of both texts in a part, on average; tables tried at most, and
#: thirds looked at in each.
CELLS, PART, TRIES, ROUNDS = 6, 10, 8, 12
LONG = 400
BITS, HALF = 60, 1 << 30
#: Multipliers of a digest's two halves, below 2^31, and the prime of the check.
CHECK = (1_103_515_245, 1_442_695_041, 2_147_483_629)
FOUND, NONE = "array<struct<n:int,d:bigint>>", "named_struct('n', 0, 'd', 0L, 'c', 0L)"


def digests(text: Column) -> Column:
    """The distinct digests, of 60 bits, of a text's paragraphs: its lines, those of over LONG characters cut at [.!?], without white
    space around them."""
    lines = F.transform(F.split(or_empty(text), "\n"), lambda x: F.when(F.length(x) <= LONG, F.array(x)).otherwise(F.split(x, "[.!?]+")))
    whole = F.filter(F.transform(F.flatten(lines), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: x != "")
    return F.array_distinct(F.transform(whole, lambda x: F.conv(F.substring(F.md5(x), 1, BITS // 4), 16, 10).cast("long")))


def check(digest: Column) -> Column:
    """A number that sums and xors of other digests don't have by chance."""
    return F.pmod(F.shiftright(digest, 30) * CHECK[0] + digest.bitwiseAND(F.lit(HALF - 1)) * CHECK[1], F.lit(CHECK[2]))


def place(digest: Column, third: int, cells: Column | int, attempt: Column | int) -> Column:
    """A digest's cell in a third of a table; another attempt has others."""
    mixed = F.when(attempt == 0, digest).otherwise(F.abs(F.xxhash64(attempt, digest))) if isinstance(attempt, Column) else digest
    return F.pmod(F.shiftright(mixed, 20 * third), cells if isinstance(cells, Column) else F.lit(cells)).cast("int")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cell(n: Column, digest: Column, checked: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), digest.alias("d"), checked.alias("c"))


def placed(lone: Column, cells: Column | int, attempt: Column | int) -> Column:
    """Structs with a digest d and a number n, with the check and the digest's place in each third."""
    return F.transform(lone, lambda e: F.struct(e["n"].alias("n"), e["d"].alias("d"), check(e["d"]).alias("c"), *(place(e["d"], j, cells, attempt).alias(f"p{j}") for j in range(3))))


def added(x: Column, i: Column, entries: Column, third: int, sign: int) -> Column:
    """A third's cell i with the entries that belong there added, or taken out."""
    put = lambda y, e: cell(y["n"] + e["n"] if sign > 0 else y["n"] - e["n"], y["d"].bitwiseXOR(e["d"]), y["c"].bitwiseXOR(e["c"]))
    return F.aggregate(entries, x, lambda y, e: F.when(e[f"p{third}"] == i, put(y, e)).otherwise(y))


def sketch(found: Column, cells: Column | int, attempt: Column | int = 0) -> Column:
    """The table of an array of digests: 3 * cells structs of the number n, the xor d of digests and the xor c of checks."""
    entries = placed(F.transform(found, lambda d: F.struct(F.lit(1).alias("n"), d.alias("d"))), cells, attempt)
    numbers = F.sequence(F.lit(0), (cells if isinstance(cells, Column) else F.lit(cells)) - 1)
    third = lambda e, j: F.transform(numbers, lambda i: added(F.expr(NONE), i, e, j, 1))
    return let(entries, lambda e: F.concat(*(third(e, j) for j in range(3))))


def minus(a: Column, b: Column) -> Column:
    """Two tables' difference, cell by cell."""
    return F.zip_with(a, b, lambda x, y: cell(x["n"] - y["n"], x["d"].bitwiseXOR(y["d"]), x["c"].bitwiseXOR(y["c"])))


def peeled(diff: Column, cells: Column | int, attempt: Column | int = 0) -> Column:
    """A struct of `found`, the differing digests with their sign n (1: only in the first text), and `t0` to `t2`, the thirds of what is left
    of the table. A third gives up its lone digests at a time, so that none is found twice; three that have none end it."""
    size = cells if isinstance(cells, Column) else F.lit(cells)
    names = ["t0", "t1", "t2", "found", "idle"]
    state = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, names, strict=True)))
    is_lone = lambda x: (F.abs(x["n"]) == 1) & (x["c"] == check(x["d"]))

    def step(st: Column, r: Column) -> Column:
        third = F.when(r % 3 == 0, st["t0"]).when(r % 3 == 1, st["t1"]).otherwise(st["t2"])

        def without(lone: Column) -> Column:
            left = lambda j: F.transform(st[f"t{j}"], lambda x, i: added(x, i, lone, j, -1))
            more = F.concat(st["found"], F.transform(lone, lambda e: F.struct(e["n"].alias("n"), e["d"].alias("d"))))
            return F.when(F.size(lone) == 0, state(st["t0"], st["t1"], st["t2"], st["found"], st["idle"] + 1)).otherwise(state(*map(left, range(3)), more, F.lit(0)))

        return F.when(st["idle"] >= 3, st).otherwise(let(placed(F.filter(third, is_lone), cells, attempt), without))

    begin = state(*(F.slice(diff, size * j + 1, size) for j in range(3)), F.array().cast(FOUND), F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step)


def is_empty(st: Column) -> Column:
    """Whether what is left of a table is nothing."""
    return ~F.exists(F.concat(st["t0"], st["t1"], st["t2"]), lambda x: (x["n"] != 0) | (x["d"] != 0) | (x["c"] != 0))


def parts(a: Column, b: Column) -> Column:
    """Both texts' digests as an array of parts (a, b) of PART digests, on average, by their remainders. They are split in two steps, each
    into about the root of the number of parts."""
    both = lambda p: F.size(p["a"]) + F.size(p["b"])
    cut_by = lambda p, n, of: F.transform(F.sequence(F.lit(0), n - 1), lambda q: F.struct(*(F.filter(p[c], lambda d: F.pmod(of(d), n) == q).alias(c) for c in ("a", "b"))))
    few = lambda p: (1 + F.floor(F.sqrt(both(p) / PART))).cast("int")
    whole = F.struct(a.alias("a"), b.alias("b"))
    some = let(whole, lambda p: F.when(both(p) <= PART, F.array(p)).otherwise(cut_by(p, few(p), lambda d: F.shiftright(d, 30))))
    return F.flatten(F.transform(some, lambda p: F.when(both(p) <= PART, F.array(p)).otherwise(cut_by(p, (1 + F.floor(both(p) / PART)).cast("int"), lambda d: F.shiftright(d, 10)))))


def differences(parts: Column) -> Column:
    """The digests that differ between the two texts of an array of parts, as structs (n, d): n is 1 for those of the first alone, -1 of the second.

    Each part's tables are built, subtracted and peeled, with twice the cells and other places as often as a table stays full.
    A table stays full TRIES times only where two digests of a part have the same three cells of up to 768 each time."""
    start = F.struct(F.array().cast(FOUND).alias("found"), F.lit(False).alias("ok"))

    def tried(p: Column, k: Column) -> Column:
        cells = F.call_function("shiftleft", F.lit(CELLS), k)
        diff = F.array(minus(sketch(p["a"], cells, k), sketch(p["b"], cells, k)))
        done = F.transform(diff, lambda t: peeled(t, cells, k))
        return F.element_at(F.transform(done, lambda t: F.struct(t["found"].alias("found"), is_empty(t).alias("ok"))), 1)

    each = F.transform(parts, lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(TRIES)), start, lambda st, k: F.when(st["ok"], st).otherwise(tried(p, k)))["found"])
    return F.flatten(each)


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """The share of both texts' distinct digests that both have; 1 where neither has any."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - differ) / (n + differ))


def printed(cells: Column) -> Column:
    """A table as text: for each cell 8 hexadecimal digits of its number, 16 of its digests and 8 of its checks."""
    return F.array_join(F.transform(cells, lambda x: F.concat(*(F.lpad(F.lower(F.hex(x[n])), width, "0") for n, width in (("n", 8), ("d", 16), ("c", 8))))), "")


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text, 18 cells as text. Texts with the same paragraphs have the same; null is like empty. All
    rows and columns come back (a column itself named `into` is replaced); a text of any length has a fingerprint of one size."""
    return docs.withColumn(into, printed(sketch(digests(F.col(text)), CELLS)))


def followed(keys: DataFrame, key: list[str]) -> DataFrame:
    """Distinct rows, each with the columns of the next one under next_ names, in descending order of `key`, nulls last; after the last
    comes the first. Ranges are sorted, each in a task; what comes before each is counted."""
    down = [F.col(c).desc_nulls_last() for c in key]
    rows = cut(keys.orderBy(*down).withColumn("__range", F.spark_partition_id()))
    counts = rows.groupBy(F.col("__range").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))  # as many rows as there are ranges
    before = counts.select("__of", F.coalesce(F.sum("__n").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*down))
    placed = cut(rows.join(F.broadcast(before), F.col("__range") == F.col("__of")).select(*keys.columns, (within + F.col("__before")).alias("__row")))
    n = placed.count()
    ahead = placed.select(*(F.col(c).alias(f"next_{c}") for c in keys.columns), F.when(F.col("__row") == 1, F.lit(n)).otherwise(F.col("__row") - 1).cast("long").alias("__row"))
    return placed.withColumn("__row", F.col("__row").cast("long")).join(ahead, "__row").drop("__row")


def compared(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs: its text is held against one
    edited from it, whose last half (rounded down, in code points) is the beginning of the next document, as long or all of it,
    and against the next document itself.

    The next document has the largest smaller id; null ids come last, and after the last comes the first. Of documents with one
    id that with the smaller hash comes last. Rows with equal id and text are one document and come back each,
    alike. A null text is empty; texts without paragraphs are alike. An empty table gives an empty table; other columns are left out.

    Only ids and lengths are sorted. Texts are digested and dealt out once, by a hash of id and text; the next document's beginning and
    digests come to it in a second shuffle. Tables are built, subtracted and peeled in columns; a part of a long text's digests
    has a small table of its own, so that work grows with the number of paragraphs.
    """
    whole = or_empty(F.col(text))
    about = [F.col(id).isNull(), F.col(id), whole]
    named = docs.select(F.col(id).alias("doc"), whole.alias("text"), *(F.xxhash64(F.lit(k), *about).alias(f"h{k}") for k in (1, 2)))
    rows = named.withColumn("own", digests(F.col("text"))).repartition("h1", "h2")  # one shuffle, which both joins read
    keys = named.select("doc", "h1", "h2", F.length("text").alias("n_chars")).distinct()
    chain = cut(followed(keys, ["doc", "h1", "h2"]).select("h1", "h2", "n_chars", "next_h1", "next_h2"))
    wanted = chain.select(F.col("h1").alias("my_h1"), F.col("h2").alias("my_h2"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"), F.col("next_h1").alias("h1"), F.col("next_h2").alias("h2"))
    begin = F.struct(F.substring("text", F.lit(1), F.col("half")).alias("begin"), F.col("own").alias("digests"), F.col("doc").alias("of"))  # all columns, so that both shuffles are one
    ahead = rows.join(wanted, ["h1", "h2"]).groupBy("my_h1", "my_h2").agg(F.first(begin).alias("next"))
    both = rows.join(ahead, (F.col("h1") == F.col("my_h1")) & (F.col("h2") == F.col("my_h2")))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("next.begin"))
    out = both.select("doc", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", digests(edited).alias("after"), F.col("next.digests").alias("ahead"))
    out = out.select("doc", "n_chars", "edited", "own", "after", "ahead", *(sketch(F.col(c), CELLS).alias(f"{c}_cells") for c in ("own", "after", "ahead")))
    for c in ("after", "ahead"):  # the fingerprints, then larger tables where their difference does not peel
        out = out.withColumn("first", minus(F.col("own_cells"), F.col(f"{c}_cells")))
        out = out.withColumn("first", peeled(F.col("first"), CELLS))
        out = out.withColumn("parts", F.when(~is_empty(F.col("first")), parts(F.col("own"), F.col(c))))
        found = F.coalesce(differences(F.col("parts")), F.col("first.found"))
        out = out.withColumn("differ", F.size(found))  # a column of its own: what names it twice would find it twice
        out = out.withColumn(f"near_{c}", likeness(F.col("own"), F.col(c), F.col("differ"))).drop("first", "parts", "differ")
    return out.select("doc", "n_chars", "edited", printed(F.col("own_cells")).alias("fingerprint"), printed(F.col("after_cells")).alias("edited_fingerprint"), F.col("near_after").alias("near_edited"), F.col("near_ahead").alias("near_next"))


def op13_lookup_sketches(spark, sf_dir: str) -> DataFrame:
    found = compared(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS ahead FROM d
  WINDOW o AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, n, text, ahead, substr(text, 1, n - n // 2) || substr(ahead, 1, n // 2) AS edited FROM n),
t AS (SELECT doc_id, unnest(['own', 'after', 'ahead']) AS kind, unnest([text, edited, ahead]) AS t FROM e),
y AS (SELECT doc_id, kind, unnest(string_split(t, chr(10))) AS y FROM t),
p AS (SELECT doc_id, kind, regexp_replace(unnest(CASE WHEN length(y) <= {LONG} THEN [y] ELSE string_split_regex(y, '[.!?]+') END), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x FROM y),
g AS (SELECT DISTINCT doc_id, kind, ('0x' || substr(md5(x), 1, 15))::BIGINT AS d FROM p WHERE x <> ''),
c AS (SELECT doc_id, kind, {CELLS} * j + (d >> (20 * j)) % {CELLS} AS i, count(*) AS n, bit_xor(d) AS d, bit_xor(((d >> 30) * {CHECK[0]} + (d & {HALF - 1}) * {CHECK[1]}) % {CHECK[2]}) AS c
  FROM (SELECT *, unnest([0, 1, 2]) AS j FROM g) GROUP BY ALL),
f AS (SELECT k.doc_id, k.kind, string_agg(lpad(lower(to_hex(coalesce(c.n, 0))), 8, '0') || lpad(lower(to_hex(coalesce(c.d, 0))), 16, '0') || lpad(lower(to_hex(coalesce(c.c, 0))), 8, '0'), '' ORDER BY k.i) AS print
  FROM (SELECT doc_id, kind, unnest(range({3 * CELLS})) AS i FROM t WHERE kind <> 'ahead') k LEFT JOIN c ON c.doc_id = k.doc_id AND c.kind = k.kind AND c.i = k.i GROUP BY k.doc_id, k.kind),
s AS (SELECT doc_id, kind, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT g.doc_id, h.kind, count(*) AS n FROM g JOIN g h ON g.doc_id = h.doc_id AND g.d = h.d WHERE g.kind = 'own' AND h.kind <> 'own' GROUP BY ALL),
l AS (SELECT e.doc_id, k.kind, coalesce(o.n, 0) + coalesce(s.n, 0) AS n, coalesce(o.n, 0) + coalesce(s.n, 0) - 2 * coalesce(b.n, 0) AS d FROM e CROSS JOIN (SELECT unnest(['after', 'ahead']) AS kind) k
  LEFT JOIN s o ON o.doc_id = e.doc_id AND o.kind = 'own' LEFT JOIN s ON s.doc_id = e.doc_id AND s.kind = k.kind LEFT JOIN b ON b.doc_id = e.doc_id AND b.kind = k.kind),
r AS (SELECT doc_id, kind, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE (n - d)::DOUBLE / (n + d) END AS near FROM l)
SELECT e.doc_id, e.n AS n_chars, sha256(edited) AS edited_sha256, f.print AS fingerprint, h.print AS edited_fingerprint, r.near AS near_edited, q.near AS near_next
FROM e JOIN f ON f.doc_id = e.doc_id AND f.kind = 'own' JOIN f h ON h.doc_id = e.doc_id AND h.kind = 'after' JOIN r ON r.doc_id = e.doc_id AND r.kind = 'after' JOIN r q ON q.doc_id = e.doc_id AND q.kind = 'ahead'
"""
