"""Line dedup with a fixed-depth log-template tree.

Every line is masked (tokens with a digit become ``<*>``) and routed by its
token count and its first ``DEPTH`` tokens to a leaf.  In a leaf, a token is
fixed at its position if at least ``MIN_DOCS`` texts have it there; the other
positions are variable fields.  A line whose fixed share is at least
``MIN_FIXED`` takes the generalised template, any other line is its own.  A
template that recurs in ``MIN_DOCS`` different texts is dropped from all, and so
is a line of ``LONG`` tokens or more that recurs in ``MIN_LONG``.  A line that
recurs as it stands has no variable field, so its rarer variants stay unless
they recur themselves.

Copies and near copies of whole documents repeat every line, which makes no
line boilerplate.  So equal texts count once, and a text of which recurring
lines make up ``COPY_SHARE`` of the tokens or more does not vote on what
recurs, unless a single template is all that recurs in it, and a short one or
one of ``MIN_DOCS`` texts; lines that recur in other texts are still dropped
from it.

Only DataFrame functions are used.  What is shuffled is hashes of lines; of
texts only those with something to drop move, for the final join, whose both
sides are plain tables, so Spark splits the copies of one text.  Counts are
pre-aggregated before every shuffle, so a line in a third of all documents is
one row per map task.  What is broadcast are bit tables of at most ``SLOTS /
64`` rows.  Lines are known by 64-bit hashes.

Defined cases: null text stays null with no lines; blank lines and lines of
fewer than ``MIN_TOKENS`` tokens are never dropped; documents keep their row
even if no line stays; repeated rows are treated alike; an empty table gives
no rows; very long texts and lines are read whole; other columns pass through,
whatever their names, but for two that carry the names of the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits
from .store import materialize, table

DEPTH = 4
MIN_TOKENS = 4
MIN_DOCS = 4
MIN_FIXED = 0.7
#: a line of so many tokens recurs in fewer texts
LONG, MIN_LONG = 50, 2
COPY_SHARE = 0.5
SLOTS = 1 << 20
#: tokens with a digit, from their start on, and runs of blanks inside a line
MASKED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
BLANKS = r"[\x20\x09\x0B-\x0D]++"


def _masked(line: Column) -> Column:
    """A line with masked tokens and single blanks; most lines need no pattern but the first."""
    plain = ~line.rlike(r"[0-9\x09\x0B-\x0D]") & ~F.contains(line, F.lit("  "))
    return F.trim(F.when(plain, line).otherwise(F.regexp_replace(F.regexp_replace(line, MASKED, "<*>"), BLANKS, " ")))


def _count(line: Column) -> Column:
    """Tokens of a masked line."""
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int")


def _leaf(line: Column) -> Column:
    return F.xxhash64(_count(line), F.substring_index(line, " ", DEPTH))


def _exploded(docs: DataFrame) -> DataFrame:
    """(k, line): the masked lines of every text.

    Masking happens inside the arrays that are exploded: filters and joins on
    what follows cannot make Spark evaluate its patterns again.  The key is
    taken before the lines are exploded, so no line carries its text along.
    """
    lines = docs.select(F.xxhash64("text").alias("k"), F.transform(F.split("text", "\n"), _masked).alias("lines"))
    return lines.select("k", F.explode("lines").alias("line"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(text key, template, leaf, tokens) for each distinct template of each distinct text."""
    rows = _exploded(docs).select("k", F.xxhash64("line").alias("t"), _leaf(F.col("line")).alias("leaf"), _count(F.col("line")).alias("n"))
    return rows.groupBy("k", "t").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n")).filter(f"n >= {MIN_TOKENS}")


def _slot(leaf: Column) -> Column:
    return F.pmod(leaf, F.lit(SLOTS))


def _bits(leaves: DataFrame) -> DataFrame:
    """At most SLOTS / 64 rows that say which slots hold a leaf."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(leaf, {SLOTS}) % 64 as int))")
    return leaves.groupBy(F.floor(_slot(F.col("leaf")) / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _generalised(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(t, g): lines that take a template with variable fields.

    ``counts`` has (t, leaf, df).  Only lines of leaves with several different
    lines are looked at; they are fetched by the bit table first and by an
    exact join then.
    """
    leaves = counts.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n"), F.sum("df").alias("_df")).filter(f"_n > 1 AND _df >= {MIN_DOCS}").select("leaf")
    leaves = materialize(leaves, "line-leaves")
    bits = F.broadcast(_bits(leaves))
    lines = _exploded(docs).select("line", _leaf(F.col("line")).alias("leaf"))
    lines = lines.withColumn("word", F.floor(_slot(F.col("leaf")) / 64))
    near = lines.join(bits, "word").filter("getbit(bits, cast(pmod(leaf, 64) as int)) = 1")
    near = near.select("leaf", F.xxhash64("line").alias("t"), "line").groupBy("leaf", "t").agg(F.first("line").alias("line"))
    near = materialize(near.join(leaves, "leaf", "left_semi").join(counts.select("t", "df"), "t"), "line-near")
    fields = near.select("leaf", "t", "df", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    fixed = fields.groupBy("leaf", "pos", "token").agg(F.sum("df").alias("_df")).filter(f"_df >= {MIN_DOCS}").drop("_df")
    kept = fields.join(fixed, ["leaf", "pos", "token"]).groupBy("leaf", "t").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("kept"))
    sizes = near.select("t", _count(F.col("line")).alias("n"))
    wide = kept.join(sizes, "t").filter((F.size("kept") < F.col("n")) & (F.size("kept") >= F.lit(MIN_FIXED) * F.col("n")) & (F.size("kept") >= MIN_TOKENS))
    return wide.select("t", F.xxhash64("leaf", F.to_json("kept")).alias("g"))


def dropped_templates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((k, t, g) occurrences of templates that may recur, g of the templates that go)."""
    occ = materialize(_occurrences(docs), "line-occurrences")
    counts = materialize(occ.groupBy("t").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.count(F.lit(1)).alias("df")), "line-counts")
    wide = _generalised(docs, counts)
    # lines that recur as they stand are their own templates
    names = counts.join(wide, "t", "left").select("t", "n", "df", F.when((F.col("df") < MIN_DOCS), F.col("g")).alias("g"))
    groups = names.filter("g is not null").groupBy("g").agg(F.sum("df").alias("_df")).filter(f"_df >= {MIN_DOCS}").select("g", F.lit(True).alias("_in"))
    named = names.join(groups, "g", "left").filter(f"df >= {MIN_DOCS} OR _in OR (n >= {LONG} AND df >= {MIN_LONG})")
    own = (F.col("df") >= MIN_DOCS) | F.col("_in").isNull()
    recurring = named.select("t", F.when(own, F.col("t")).otherwise(F.col("g")).alias("g"), (F.col("_in").isNull() & (F.col("df") < MIN_DOCS)).alias("few"))
    recurring = materialize(recurring, "line-recurring")
    hits = materialize(occ.join(recurring, "t").select("k", "t", "g", "n", "few"), "line-hits")
    often = lambda c: F.when(~F.col("few"), F.col(c))
    mine = hits.groupBy("k").agg(F.sum("n").alias("_hit"), F.sum(often("n")).alias("_often"), F.min(often("g")).alias("_g0"), F.max(often("g")).alias("_g1"))
    whole = occ.groupBy("k").agg(F.sum("n").alias("_all"))
    share = lambda c: F.col(c) < F.lit(COPY_SHARE) * F.col("_all")
    voters = mine.join(whole, "k").select("k", share("_hit").alias("_few"), F.coalesce(share("_often") | (F.col("_g0") == F.col("_g1")), F.lit(False)).alias("_short")).filter("_few OR _short")
    votes = hits.join(voters, "k").filter("if(few, _few, _short)").select("k", "g", "few").distinct().groupBy("g", "few").agg(F.count(F.lit(1)).alias("_df"))
    return hits, votes.filter(f"_df >= if(few, {MIN_LONG}, {MIN_DOCS})").select("g")


def drop_templates(docs: DataFrame, text: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents with recurring lines dropped; adds two columns, lines and dropped lines, named ``counts``.

    A column of the input that has one of these names gives way; name them
    otherwise to keep it.
    """
    hits, gone = dropped_templates(docs.select(docs[text].alias("text")))
    bad = materialize(hits.join(gone, "g", "left_semi").groupBy("k").agg(F.collect_set("t").alias("bad")), "line-bad")
    names = [c for c in docs.columns if c not in counts]
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[text].alias("text"))
    # null texts have no lines and meet nothing; only texts whose bit is set are shuffled
    rows = bits.marked(rows.withColumn("k", F.when(F.col("text").isNotNull(), F.xxhash64("text"))), F.coalesce("k", F.lit(0)), bits.table_of(bad, "k"), name="maybe")
    near = rows.filter("maybe AND text IS NOT NULL").join(bad.hint("shuffle_hash"), "k", "left").select("row", "text", "bad")
    far = rows.filter("NOT maybe OR text IS NULL").select("row", "text", F.lit(None).cast("array<bigint>").alias("bad"))
    # only lines of MIN_TOKENS tokens or more have their hash in bad
    stays = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("bad"), F.xxhash64(_masked(x))))
    near = near.withColumn("kept", F.when(F.col("bad").isNotNull(), stays))
    near = near.select("row", "text", F.size("kept").cast("long").alias("n_left"), F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("left"), F.col("bad").isNull().alias("whole"))
    out = near.unionByName(far.select("row", "text", F.lit(None).cast("long").alias("n_left"), F.col("text").alias("left"), F.lit(True).alias("whole")))
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n_lines = F.coalesce(F.when(F.col("text") != "", breaks + 1), F.lit(0)).cast("long")
    dropped = F.when(F.col("whole"), F.lit(0)).otherwise(n_lines - F.col("n_left")).cast("long")
    made = [F.col("left").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]
    return out.select(*made, n_lines.alias(counts[0]), dropped.alias(counts[1]))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS raw,
         list_transform(string_split(regexp_replace(text, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), chr(10)),
                        lambda x: trim(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ')) AS masked
  FROM documents),
occ AS (SELECT DISTINCT text AS k, t, len(string_split(t, ' ')) AS n,
               len(string_split(t, ' ')) || ' ' || array_to_string(string_split(t, ' ')[1:4], ' ') AS leaf
        FROM (SELECT text, unnest(masked) AS t FROM d) WHERE len(string_split(t, ' ')) >= 4),
counts AS (SELECT t, any_value(leaf) AS leaf, any_value(n) AS n, count(*) AS df FROM occ GROUP BY t),
leaves AS (SELECT leaf FROM counts GROUP BY leaf HAVING count(*) > 1 AND sum(df) >= 4),
fields AS (SELECT leaf, t, df, n, unnest(string_split(t, ' ')) AS token, generate_subscripts(string_split(t, ' '), 1) AS pos
           FROM counts WHERE leaf IN (SELECT leaf FROM leaves)),
fixed AS (SELECT leaf, pos, token FROM fields GROUP BY ALL HAVING sum(df) >= 4),
wide AS (SELECT t, any_value(leaf) || ':' || string_agg(pos || '=' || token, ' ' ORDER BY pos) AS g
         FROM fields JOIN fixed USING (leaf, pos, token) GROUP BY t HAVING count(*) < any_value(n) AND count(*) >= 0.7 * any_value(n) AND count(*) >= 4),
names AS (SELECT c.t, c.n, c.df, CASE WHEN c.df < 4 THEN w.g END AS g FROM counts c LEFT JOIN wide w ON c.t = w.t),
grouped AS (SELECT g FROM names WHERE g IS NOT NULL GROUP BY g HAVING sum(df) >= 4),
recurring AS (SELECT t, 'own ' || t AS g, false AS few FROM names WHERE df >= 4
              UNION ALL SELECT t, g, false FROM names WHERE g IN (SELECT g FROM grouped)
              UNION ALL SELECT t, 'own ' || t, true FROM names WHERE df BETWEEN 2 AND 3 AND n >= 50 AND (g IS NULL OR g NOT IN (SELECT g FROM grouped))),
hits AS (SELECT k, t, g, n, few FROM occ JOIN recurring USING (t)),
voters AS (SELECT k, hit < 0.5 * al AS v_few, coalesce(often < 0.5 * al OR kinds = 1, false) AS v_short
           FROM (SELECT k, sum(n) AS hit, sum(n) FILTER (WHERE NOT few) AS often, count(DISTINCT g) FILTER (WHERE NOT few) AS kinds FROM hits GROUP BY k) JOIN (SELECT k, sum(n) AS al FROM occ GROUP BY k) USING (k)),
gone AS (SELECT g FROM (SELECT DISTINCT k, g, few FROM hits JOIN voters USING (k) WHERE CASE WHEN few THEN v_few ELSE v_short END) GROUP BY g, few HAVING count(*) >= CASE WHEN few THEN 2 ELSE 4 END),
bad AS (SELECT k, list(DISTINCT t) AS ts FROM hits WHERE g IN (SELECT g FROM gone) GROUP BY k),
kept AS (SELECT d.doc_id, d.text, d.raw, d.masked, CASE WHEN bad.ts IS NULL THEN list_transform(d.raw, lambda x: true)
                ELSE list_transform(d.masked, lambda x: NOT list_contains(bad.ts, x)) END AS ok
         FROM d LEFT JOIN bad ON d.text = bad.k)
SELECT doc_id, CAST(CASE WHEN text <> '' THEN len(raw) ELSE 0 END AS BIGINT) AS n_lines,
       CAST(CASE WHEN text <> '' THEN len(list_filter(ok, lambda x: NOT x)) ELSE 0 END AS BIGINT) AS n_dropped,
       md5(array_to_string(list_where(raw, ok), chr(10))) AS text_md5
FROM kept
"""
