"""Line de-duplication by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared as sequences of words (between ASCII white space). Of equal lines the
earliest stays, by (id, line number). A line of `min_words` words or more also goes if an
earlier one has an equal variant, with at most one word left out: one word inserted, deleted
or replaced, or one word taken away and another put in at a different place. Variants are
joined as hashed keys, and the words that remain are compared themselves. A group of lines
with the same variant needs no pairs: all of them but its earliest go.

Before variants are made, lines without a possible partner are set aside exactly: lines with
an equal variant have a third of their words in common, at the same end or in the middle, so
a line that shares none of its six part keys has no partner.

Lines without a word always stay. Null texts stay null, empty ones empty. Rows with equal
id and text are taken as one text and get equal results; a null id comes after all others.
Of lines that tie in id and number (repeated ids) the one of the lower text hash is earlier.
Texts of any length are taken whole. An empty table gives an empty table. Columns named like
a result (n_lines, n_exact, n_near) are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import column, discard, materialise, others

SPACES = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def plain_line(line: Column) -> Column:
    """The words of a line, with one space between two. Most lines need no pattern for that."""
    bare = F.btrim(line, F.lit(BLANKS))
    odd = [F.contains(bare, F.lit(c)) for c in ("  ", "\t", "\r", "\x0b", "\x0c")]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3] | odd[4], F.regexp_replace(bare, SPACES, " ")).otherwise(bare)


def filled(line: Column) -> Column:
    """Whether a line has a word."""
    return F.ltrim(line, F.lit(BLANKS)) != ""


def line_hashes(plain: str) -> list[Column]:
    """Two hashes of a plain line, which name it."""
    return [F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain).alias("h2")]


def with_part_keys(lines: DataFrame, plain: str, n: str, least: int) -> DataFrame:
    """lines with `parts`, hashes of thirds of a line of n words: two lines with an equal variant have one in common.

    Of lines with as many words: the first or the last third if a word left out lies in the
    middle or both lie in the same third, else the middle, one place further in one of them.
    If one line is a word longer, its first or last third by the size of the shorter. The first
    and the last third are cut out of the text, and the rest of it by their lengths: words are
    never put apart, and no part of a line is searched twice.
    """
    line, size = F.col(plain), F.col(n)

    def words(text: Column, count: Column | int) -> Column:
        return F.call_function("substring_index", text, F.lit(" "), F.lit(count).cast("int"))

    def cut(start: Column, length: Column) -> Column:
        """Bytes of the line, from place 0."""
        return F.substring(line.cast("binary"), (start + 1).cast("int"), length.cast("int")).cast("string")

    def two(seed: int, s: Column, text: Column) -> Column:
        return F.xxhash64(F.lit(seed), s, text)

    long, third, whole = size >= least, F.floor(size / 3), F.octet_length(line)
    space = F.when(third > 0, 1).otherwise(0)  # lines of one or two words have no ends
    rows = lines.withColumns({"_head": F.when(long, words(line, third)), "_tail": F.when(long, words(line, -third))})
    head, tail = F.col("_head"), F.col("_tail")
    rows = rows.withColumns({"_a": F.octet_length(head), "_c": F.octet_length(tail), "_last": F.octet_length(words(head, -1))})
    rows = rows.withColumn("_middle", F.when(long, cut(F.col("_a") + space, whole - F.col("_a") - F.col("_c") - 2 * space)))
    middle, last = F.col("_middle"), F.col("_last")
    # one place further: with the word before it, without its last one
    moved = cut(F.col("_a") - last, last + F.octet_length(middle) - F.octet_length(words(middle, -1)) + space - 1)
    own = [two(0, size, head), two(1, size, tail), two(2, size, middle), two(2, size, moved)]
    # by the size of a line that is a word shorter; a third of that has a word less if size is a multiple of three
    less = size % 3 == 0
    shorter = F.when(less, cut(F.lit(0), F.col("_a") - last - 1)).otherwise(head)
    first = F.octet_length(words(tail, 1))
    later = F.when(less, cut(whole - F.col("_c") + first + 1, F.col("_c") - first - 1)).otherwise(tail)
    parts = F.when(size < least, F.array().cast("array<bigint>")).when(size == least, F.array(*own)).otherwise(F.array(*own, two(0, size - 1, shorter), two(1, size - 1, later)))
    return rows.withColumn("parts", parts).drop("_head", "_tail", "_a", "_c", "_last", "_middle")


def without(words: str, at: str) -> Column:
    """The elements but the one at a place from 1 (0: all of them)."""
    w, k = F.col(words), F.col(at)
    return F.when(k == 0, w).otherwise(F.concat(F.slice(w, F.lit(1), F.greatest(k - 1, F.lit(0))), F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0)))))


#: A sieve has 8 bits a member, and 32 megabytes at most; beyond, it lets more through to the exact join behind it.
PAGE, LEAST_BITS, MOST_BITS = 1 << 15, 1 << 20, 1 << 28


def sieve_bits(members: int) -> int:
    """Bits of a sieve: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * members).bit_length()))


def sieve(members: DataFrame, name: str, size: int) -> DataFrame:
    """(page, bytes): a bitmap of the hashes of a column's values, in at most size / PAGE rows."""
    place = F.pmod(F.xxhash64(name), F.lit(size))
    held = members.select(F.floor(place / PAGE).cast("int").alias("page"), (place % PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # signed bytes: a byte of an array is found without any text in between
    value = F.transform(F.sequence(F.lit(1), F.length("bits")), lambda k: F.conv(F.hex(F.substring("bits", k, 1)), 16, 10).cast("int"))
    return held.select("page", F.transform(value, lambda v: F.when(v > 127, v - 256).otherwise(v).cast("tinyint")).alias("bytes"))


def marked(df: DataFrame, name: str, members: DataFrame) -> DataFrame:
    """df with `_in`: false only where the column's value is none of the members', which is a stored table."""
    size = sieve_bits(members.count())
    held = F.broadcast(sieve(members, name, size))
    place = F.pmod(F.xxhash64(name), F.lit(size))
    rows = df.withColumn("_page", F.floor(place / PAGE).cast("int")).withColumn("_bit", (place % PAGE).cast("int"))
    rows = rows.join(held, F.col("_page") == F.col("page"), "left")
    one = F.expr("bit_get(get(bytes, _bit div 8), _bit % 8) = 1")
    return rows.withColumn("_in", F.coalesce(one, F.lit(False))).drop("_page", "_bit", "page", "bytes")


def near_lines(docs: DataFrame, lines: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2) of distinct lines with a variant that an earlier line has, too. docs have `doc` and `text`."""
    keys = lines.filter(F.col("n") >= min_words).select("h1", "h2", F.explode("parts").alias("part"))
    shared = materialise(keys.groupBy("part").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo != hi").select("part"), "parts")
    # the sieve lets few others through, so what is joined exactly is small
    some = marked(keys, "part", shared).filter("_in").drop("_in").join(shared, "part").select("h1", "h2").distinct()
    # the earliest place of such a line tells where to read its words
    places = materialise(distinct.join(some, ["h1", "h2"]).select(F.col("first.doc").alias("doc"), F.col("first.line_no").alias("line_no"), "first"), "places")
    held = marked(docs.select("doc", "text"), "doc", places.select("doc")).filter("_in").drop("_in").dropDuplicates(["doc"])
    found = held.join(places, "doc").select("first", plain_line(F.element_at(F.split("text", "\n"), F.col("line_no") + 1)).alias("line"))
    found = found.select("first", F.split("line", " ").alias("words"), *line_hashes("line"))
    found = found.withColumn("marks", F.transform("words", lambda w: F.xxhash64(w)))
    whole = F.aggregate("marks", F.lit(0).cast("bigint"), lambda x, h: x.bitwiseXOR(h))
    found = materialise(found.withColumn("whole", whole), "candidates")
    # a variant's mark ignores the order of words, so that all variants of a line cost its length, not the square of it
    marks = F.concat(
        F.array(F.struct(F.lit(0).alias("at"), F.xxhash64("whole", F.size("words")).alias("mark"))),
        F.transform("marks", lambda h, k: F.struct((k + 1).alias("at"), F.xxhash64(F.col("whole").bitwiseXOR(h), F.size("words") - 1).alias("mark"))),
    )
    variants = found.select("h1", "h2", F.explode(marks).alias("v")).select("h1", "h2", "v.at", "v.mark")
    met = materialise(variants.groupBy("mark").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo != hi").select("mark"), "met")
    # few others pass the sieve; they are groups of one, which lose nothing
    hits = marked(variants, "mark", met).filter("_in").select("h1", "h2", "at")
    rest = hits.join(found.select("h1", "h2", "first", "marks"), ["h1", "h2"]).withColumn("rest", without("marks", "at"))
    rest = materialise(rest.select("h1", "h2", "first", "at", F.xxhash64("rest").alias("r1"), F.xxhash64(F.lit(1), "rest").alias("r2")), "variants")
    best = rest.groupBy("r1", "r2").agg(F.min(F.struct("first", "at")).alias("best"))
    # all lines of a group go but its earliest; every group of a line counts, and its words are compared in each
    pairs = rest.join(best, ["r1", "r2"]).filter(F.col("best.first") < F.col("first")).select("h1", "h2", "at", F.col("best.first").alias("best"), F.col("best.at").alias("best_at"))
    one = found.select("h1", "h2", F.col("words").alias("a"))
    two = found.select(F.col("first").alias("best"), F.col("words").alias("b"))
    same = pairs.join(one, ["h1", "h2"]).join(two, "best").filter(without("a", "at") == without("b", "best_at"))
    gone = materialise(same.select("h1", "h2").distinct(), "gone")
    for table in (shared, places, found, met, rest):
        discard(docs.sparkSession, table)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 8) -> DataFrame:
    """docs with the lines that stay, and n_lines (lines with a word), n_exact and n_near (lines that went)."""
    own = others(docs, ("n_lines", "n_exact", "n_near"))
    rest = [c for c in own if c != text]
    # rows with equal id and text are one text: (null or not, id, hash of the text), which orders them, too
    key = column(id_col)
    doc = F.struct(key.isNull().alias("absent"), key.alias("id"), F.xxhash64(column(text)).alias("text"))
    keyed = docs.select((F.struct(*map(column, rest)) if rest else F.lit(0)).alias("row"), column(text).alias("text"), doc.alias("doc"))
    lines = keyed.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(filled(F.col("line"))).select("doc", "line_no", plain_line(F.col("line")).alias("line"))
    lines = lines.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    lines = with_part_keys(lines, "line", "n", min_words).select("doc", "line_no", "n", *line_hashes("line"), "parts")
    lines = materialise(lines, "lines", pack=False)
    here = F.struct("doc", "line_no")
    distinct = materialise(lines.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("copies")), "distinct")
    gone = near_lines(keyed, lines, distinct, min_words).withColumn("near", F.lit(True))
    odd = distinct.join(gone, ["h1", "h2"], "left").filter((F.col("copies") > 1) | F.col("near"))
    later = F.col("first") < here
    lost = lines.select("doc", "line_no", "h1", "h2").join(odd, ["h1", "h2"]).filter(later | F.col("near")).select("doc", "line_no", later.alias("later"))
    places = lost.groupBy("doc").agg(F.collect_set(F.when(F.col("later"), F.col("line_no"))).alias("exact"), F.collect_set(F.when(~F.col("later"), F.col("line_no"))).alias("near"))
    places = materialise(places, "lost")
    for table in (lines, distinct):
        discard(docs.sparkSession, table)
    # texts that lose nothing are not moved
    told = marked(keyed, "doc", places.select("doc"))
    unchanged = told.filter("not _in").withColumn("exact", F.array().cast("array<int>")).withColumn("near", F.array().cast("array<int>"))
    changed = told.filter("_in").join(places.withColumnRenamed("doc", "_doc"), F.col("doc").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    out = unchanged.unionByName(changed.withColumn("exact", F.coalesce("exact", F.array().cast("array<int>"))).withColumn("near", F.coalesce("near", F.array().cast("array<int>"))))
    all_lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.concat("exact", "near"))
    kept = F.when(F.size("exact") + F.size("near") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.element_at(all_lines, k + 1)), "\n"))
    n_lines = F.size(F.filter(all_lines, filled))
    return out.select(
        *[(kept if c == text else F.col("row").getField(c)).alias(c) for c in own],
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.size("exact").cast("long").alias("n_exact"),
        F.size("near").cast("long").alias("n_near"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Counts of the lines of every document that went, and a digest of its text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = r"""
lines AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l,
         list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs} WHERE text IS NOT NULL)
), own AS (
  SELECT w, min(struct_pack(d := doc_id, k := line_no)) AS f FROM lines WHERE len(w) > 0 GROUP BY w
), variants AS (
  SELECT w, f, w AS v FROM own WHERE len(w) >= 8
  UNION ALL
  SELECT w, f, list_concat(w[1:i-1], w[i+1:]) FROM (SELECT w, f, unnest(range(1, len(w) + 1)) AS i FROM own WHERE len(w) >= 8)
), best AS (SELECT v, min(f) AS f FROM variants GROUP BY v),
gone AS (SELECT DISTINCT a.w FROM variants a JOIN best b ON a.v = b.v WHERE b.f < a.f),
told AS (
  SELECT l.doc_id, l.line_no, l.l, len(l.w) AS n,
         CASE WHEN o.f < struct_pack(d := l.doc_id, k := l.line_no) THEN 1 WHEN g.w IS NOT NULL THEN 2 ELSE 0 END AS fate
  FROM lines l LEFT JOIN own o ON l.w = o.w LEFT JOIN gone g ON l.w = g.w
), cleaned AS (
  SELECT doc_id, count(*) FILTER (WHERE n > 0) AS n_lines, count(*) FILTER (WHERE fate = 1) AS n_exact, count(*) FILTER (WHERE fate = 2) AS n_near,
         coalesce(string_agg(l, chr(10) ORDER BY line_no) FILTER (WHERE fate = 0), '') AS kept
  FROM told GROUP BY doc_id
)
"""

ORACLE = (
    "WITH "
    + LINES_SQL.replace("{docs}", "documents")
    + """
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_exact, 0) AS n_exact, coalesce(c.n_near, 0) AS n_near,
       sha256(coalesce(c.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id
"""
)
