"""Line dedup with a fixed-depth log-template tree, in DataFrame functions only.

Tokens that hold a digit are masked. A line goes down the tree by its token count and its leading
tokens, a third of them, so that a leaf stays small in a large corpus of prose. As leading tokens may
be variable fields themselves, its middle and its last third lead to a leaf each too, and it belongs
to the leaf with the most different lines. In a leaf a token is constant at its position if at least
two lines and a fifth of the leaf hold it there; the rest is generalised to wildcards, and the lines
with equal results form a template, if ``SIMILARITY`` of its tokens are constant. A leaf may hold
several templates; a line with variable fields in all three thirds has no leaf to share. Equal lines
form a template of their own.

A template that stands in ``MIN_DOCS`` different documents is boilerplate, whatever its length and
neighbours, and all its lines are dropped. Copies of a document count once, or every line of a
family of copies would go before the stage that keeps one of them: equal texts are one document, and
so are texts that resemble the centre of a family. For this a text is cut behind its longer words and
at line ends into phrases of a few words. The smallest ``SKETCH`` hashes of them are its sketch, the
smallest ``KEYS`` find the family, and the similarity that the sketches of text and centre show
decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, is_small, materialize, release

#: Documents that a template stands in at least, copies of a document counting once.
MIN_DOCS = 3
#: A template in a large family of copies needs so many documents for each copy, as a few of many
#: copies are too far from the centre to be told.
STRAY = 0.02
#: Parts of a line, each of which leads to a leaf.
PARTS = 3
SIMILARITY = 0.7
#: Share of the lines of a leaf that hold a constant token at its position at least.
CONSTANT = 0.2
SKETCH, KEYS = 48, 6
#: Similarity in phrases from which a text is a copy. A changed word costs one phrase of about four
#: words, but five shingles of five words; 0.8 of shingles is about 0.84 of phrases. A sketch that
#: holds all phrases of both is exact, the estimate of others has a standard deviation of 0.05.
COPY_EXACT, COPY = 0.75, 0.65
BROADCAST_ROWS = 200_000

SPACE = r" \t\r\f\x0B"
#: A longer word with the white space behind it.
LONG_WORD = r"([^ \t\r\n]{7,})[ \t\r\n]+"


def _masked(line: Column) -> Column:
    """Tokens with digits as a wildcard, white-space runs as one space; regular expressions only where needed.

    The pattern starts at the beginning of a token only and never backtracks, so that it is linear
    in the line.
    """
    pattern = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"
    masked = F.regexp_replace(F.regexp_replace(line, pattern, "<*>"), f"[{SPACE}]+", " ")
    return F.trim(F.when(line.rlike(r"[0-9\t\r\f\x0B]") | line.contains("  "), masked).otherwise(line))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _key(text_col: str) -> Column:
    """16 bytes that stand for a text; a null text counts as empty.

    Never null, as far as Spark can tell, or a join would make it once more to look for nulls.
    """
    return F.coalesce(F.unhex(F.md5(_text(text_col).cast("binary"))), F.lit(b""))


def copy_classes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(``_t``, ``vote``) of the texts that are copies of another: text key and the key of their
    family's centre. A written table."""
    # the space at the end lets a long last word match at once
    ends = F.regexp_replace(F.concat(_text(text_col), F.lit(" ")), LONG_WORD, "$1\n")
    phrases = F.filter(F.split(ends, "\n"), lambda c: F.trim(c) != "")
    hashes = F.sort_array(F.transform(phrases, lambda c: F.md5(c.cast("binary"))))
    least = F.slice(F.array_distinct(hashes), 1, SKETCH)
    sketches = materialize(docs.select(_key(text_col).alias("_t"), F.transform(least, lambda h: F.substring(h, 1, 16)).alias("s")), "sketches")
    keyed = materialize(sketches.select("_t", F.explode(F.slice("s", 1, KEYS)).alias("h")).distinct(), "sketch-keyed")
    counted = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(keyed.join(hinted(materialize(counted, "sketch-keys"), BROADCAST_ROWS), "h"), "shared-keys")
    weight = shared.groupBy("_t").agg(F.sum("n").alias("w"), F.max(F.struct("n", "h")).getField("h").alias("h"))
    weight = materialize(weight, "sketch-weights")
    # the centre of a hash's texts is the one whose hashes are the most common
    centre = shared.join(weight.select("_t", "w"), "_t").groupBy("h").agg(F.max(F.struct("w", "_t")).getField("_t").alias("vote"))
    pairs = weight.join(materialize(centre, "centres"), "h").select("_t", "vote").filter("_t != vote")
    one = sketches.groupBy("_t").agg(F.first("s").alias("s"))
    two = one.select(F.col("_t").alias("vote"), F.col("s").alias("z"))
    pairs = materialize(pairs, "copy-pairs")
    both = pairs.join(one, "_t").join(two, "vote")
    least = F.slice(F.sort_array(F.array_union("s", "z")), 1, SKETCH)
    alike = F.size(F.array_intersect(F.array_intersect(least, F.col("s")), F.col("z"))) >= F.when(F.size(least) < SKETCH, COPY_EXACT).otherwise(COPY) * F.size(least)
    # no more of the least are in both than are in both at all, and the least are no fewer than one side has: most pairs end there, unsorted
    near = F.size(F.array_intersect("s", "z")) >= COPY * F.least(F.lit(SKETCH), F.greatest(F.size("s"), F.size("z")))
    found = materialize(both.filter(near & alike).select("_t", "vote"), "copies")
    release(sketches, keyed, shared, weight, pairs)
    return found


def line_templates(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Lines to drop: text key ``_t`` and the array ``_drop`` of line positions (from 0). A written table."""
    copies = copy_classes(docs, text_col)

    def documents(rows: DataFrame, *keys: str) -> DataFrame:
        """The keys that stand in ``min_docs`` documents at least. rows: keys and ``_t``."""
        voted = rows.select(*keys, "_t").distinct().join(hinted(copies, BROADCAST_ROWS), "_t", "left")
        voted = voted.groupBy(*keys, F.coalesce("vote", "_t").alias("vote")).agg(F.count(F.lit(1)).alias("_copies"))
        found = voted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_docs"), F.max("_copies").alias("_copies"))
        return found.filter((F.col("_docs") >= min_docs) & (F.col("_docs") >= STRAY * F.col("_copies"))).select(*keys)

    # what stands beside an explode in one select is evaluated for each of its rows: the key of a text would be made once a line;
    # and before an explode that is not outer Spark filters by the size of its array, for which the array is made twice
    listed = docs.select(_key(text_col).alias("_t"), F.transform(F.split(_text(text_col), "\n"), _masked).alias("ls"))
    rows = listed.select("_t", F.posexplode_outer("ls").alias("pos", "m")).filter("m != ''")
    rows = rows.withColumn("w", F.split("m", " ")).withColumn("n", F.size("w"))
    cut = [F.floor(F.col("n") * i / PARTS).cast("int") for i in range(PARTS + 1)]
    parts = [F.xxhash64(F.lit(i), "n", F.slice("w", cut[i] + 1, cut[i + 1] - cut[i])) for i in range(PARTS)]
    leaf_keys = [f"k{i}" for i in range(PARTS)]
    narrow = materialize(rows.select("_t", "pos", F.xxhash64("m").alias("tpl"), "n", *[p.alias(k) for p, k in zip(parts, leaf_keys, strict=True)]), "lines")

    # each different line once
    kinds = narrow.groupBy("tpl").agg(F.count(F.lit(1)).alias("times"), *[F.min(c).alias(c) for c in ("n", *leaf_keys)])
    kinds = materialize(kinds, "line-kinds")
    again = hinted(kinds.filter(F.col("times") >= min_docs).select("tpl"), BROADCAST_ROWS)
    exact = materialize(documents(narrow.join(again, "tpl", "left_semi"), "tpl"), "line-exact")

    # fewer than four tokens with a wildcard are not alike enough
    rest = kinds.filter(F.col("n") * similarity <= F.col("n") - 1).join(hinted(exact, BROADCAST_ROWS), "tpl", "left_anti")
    rest = rest.select("tpl", "n", F.posexplode(F.array(*leaf_keys)).alias("i", "leaf"))
    leaves = materialize(rest.groupBy("leaf").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "line-leaves")
    chosen = rest.join(hinted(leaves, BROADCAST_ROWS), "leaf").groupBy("tpl", "n").agg(F.max(F.struct("many", -F.col("i"), "leaf")).getField("leaf").alias("leaf"))
    chosen = materialize(chosen, "line-chosen")
    alone = chosen.groupBy("leaf").agg(F.count(F.lit(1)).alias("many"))
    leaf_of = hinted(chosen.select("tpl", "leaf"), BROADCAST_ROWS)
    # the tokens of one place of each of these lines
    place = narrow.join(leaf_of, "tpl").groupBy("tpl", "leaf").agg(F.min(F.struct("_t", "pos")).alias("p"))
    wanted = place.groupBy("p._t").agg(F.collect_list(F.struct("tpl", "leaf", "p.pos")).alias("w"))
    wanted = materialize(wanted, "line-wanted")
    texts = docs.select(_key(text_col).alias("_t"), _text(text_col).alias("_text"))
    texts = texts.join(hinted(wanted.select("_t"), BROADCAST_ROWS), "_t", "left_semi").groupBy("_t").agg(F.first("_text").alias("_text")).join(wanted, "_t")
    texts = texts.select(F.split("_text", "\n").alias("ls"), "w")
    found = texts.select(F.transform("w", lambda w: F.struct(w["tpl"].alias("tpl"), w["leaf"].alias("leaf"), _masked(F.get("ls", w["pos"])).alias("m"))).alias("w"))
    found = found.select(F.explode_outer("w").alias("w")).select("w.*")
    tokens = materialize(found.select("tpl", "leaf", F.posexplode_outer(F.split("m", " ")).alias("i", "t")), "line-tokens")
    held = tokens.groupBy("leaf", "i", "t").agg(F.count(F.lit(1)).alias("lines")).join(alone, "leaf")
    constant = held.filter((F.col("lines") > 1) & (F.col("lines") >= CONSTANT * F.col("many"))).select("leaf", "i", "t", F.xxhash64("i", "t").alias("hit"))
    shapes = tokens.join(constant, ["leaf", "i", "t"], "left").groupBy("tpl", "leaf")
    shapes = shapes.agg(F.bit_xor("hit").alias("shape"), F.count("hit").alias("fixed"), F.count(F.lit(1)).alias("all"))
    shapes = materialize(shapes.filter(F.col("fixed") >= similarity * F.col("all")).select("tpl", "leaf", "shape"), "line-shapes")
    general = documents(narrow.join(hinted(shapes, BROADCAST_ROWS), "tpl").select("leaf", "shape", "_t"), "leaf", "shape")
    bad = materialize(exact.unionByName(shapes.join(general, ["leaf", "shape"]).select("tpl")), "line-bad")
    drop = narrow.join(hinted(bad, BROADCAST_ROWS), "tpl", "left_semi").groupBy("_t").agg(F.collect_set("pos").alias("_drop"))
    drop = materialize(drop, "line-drop")
    release(copies, narrow, kinds, exact, leaves, chosen, wanted, tokens, shapes, bad)
    return drop


def drop_boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text_col``.

    Adds ``n_lines`` (lines before; null text: 0) and ``n_dropped``. All rows and columns stay; a
    text of which every line goes becomes ''; a null text stays null; equal texts get equal results,
    whatever their ids. Blank lines stay. Input columns named ``n_lines`` or ``n_dropped`` are
    replaced; other columns may have any name that does not start with ``__line``. An empty table
    gives no rows.
    """
    bad = line_templates(docs, text_col, **limits).withColumnsRenamed({"_t": "__line_k", "_drop": "__line_drop"})
    keyed = docs.withColumn("__line_key", _key(text_col))
    on = F.col("__line_key") == F.col("__line_k")
    if is_small(bad, BROADCAST_ROWS):  # texts that lose nothing stay where they are
        keys = F.broadcast(bad.select("__line_k"))
        whole = keyed.join(keys, on, "left_anti").withColumn("__line_drop", F.lit(None).cast("array<int>"))
        out = keyed.join(keys, on, "left_semi").join(bad, on).drop("__line_k").unionByName(whole)
    else:
        out = keyed.join(bad, on, "left").drop("__line_k")
    # a column of its own, so that the text is split once and not for each line
    out = out.withColumn("__line_ls", F.split(F.col(text_col), "\n"))
    lines = F.col("__line_ls")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    counts = {
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_dropped": F.when(F.col("__line_drop").isNull(), 0).otherwise(F.size("__line_drop")).cast("long"),
    }
    text = F.when(F.col("__line_drop").isNull(), F.col(text_col)).otherwise(kept)
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in counts],
        *[v.alias(k) for k, v in counts.items()],
    )


#: fixed values of the defaults above stand in the text
ORACLE = r"""
WITH s AS (SELECT doc_id, text, coalesce(text, '') AS x, md5(coalesce(text, '')) AS t FROM documents),
sketch AS (
  SELECT t, list_sort(list_distinct([md5(c)[1:16] FOR c IN string_split(regexp_replace(x || ' ', '([^ \t\r\n]{7,})[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)) IF trim(c, ' ') <> '']))[1:48] AS s
  FROM (SELECT DISTINCT t, x FROM s)),
keyed AS (SELECT t, unnest(s[1:6]) AS h FROM sketch),
shared AS (SELECT t, h, count(*) OVER (PARTITION BY h) AS n FROM keyed QUALIFY n > 1),
weight AS (SELECT t, sum(n)::BIGINT AS w, max({'n': n, 'h': h}).h AS h FROM shared GROUP BY t),
centre AS (SELECT s.h, max({'w': w, 't': t}).t AS vote FROM shared s JOIN weight USING (t) GROUP BY s.h),
pair AS (SELECT t, vote FROM weight JOIN centre USING (h) WHERE t <> vote),
twin AS (
  SELECT p.t, p.vote, a.s AS a, b.s AS b, list_sort(list_distinct(list_concat(a.s, b.s)))[1:48] AS low
  FROM pair p JOIN sketch a ON p.t = a.t JOIN sketch b ON p.vote = b.t),
copies AS (SELECT t, vote FROM twin WHERE len(list_intersect(list_intersect(low, a), b)) >= CASE WHEN len(low) < 48 THEN 0.75 ELSE 0.65 END * len(low)),
raw AS (SELECT t, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT DISTINCT t, string_split(x, chr(10)) AS ls FROM s)),
line AS (
  SELECT raw.t, i, coalesce(vote, raw.t) AS vote,
         trim(regexp_replace(regexp_replace(line, '[^ \t\r\f\x0B0-9]*[0-9][^ \t\r\f\x0B]*', '<*>', 'g'), '[ \t\r\f\x0B]+', ' ', 'g'), ' ') AS m
  FROM raw LEFT JOIN copies USING (t)),
n AS (SELECT *, len(w) AS n FROM (SELECT *, string_split(m, ' ') AS w FROM line WHERE m <> '')),
voted AS (SELECT m, vote, count(DISTINCT t) AS copies FROM n GROUP BY ALL),
exact AS (SELECT m FROM voted GROUP BY m HAVING count(*) >= 3 AND count(*) >= 0.02 * max(copies)),
rest AS (SELECT DISTINCT m, w, n FROM n ANTI JOIN exact USING (m) WHERE n * 0.7 <= n - 1),
path AS (
  SELECT m, w, n, unnest([0, 1, 2]) AS k, unnest([w[1:n // 3], w[n // 3 + 1:n * 2 // 3], w[n * 2 // 3 + 1:n]]) AS part FROM rest),
most AS (SELECT *, {'n': n, 'part': part} AS leaf, count(*) OVER (PARTITION BY k, n, part) AS many FROM path QUALIFY many > 1),
chosen AS (SELECT * FROM most QUALIFY row_number() OVER (PARTITION BY m ORDER BY many DESC, k) = 1),
size AS (SELECT k, leaf, count(*) AS many FROM chosen GROUP BY ALL),
tok AS (SELECT k, leaf, m, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM chosen),
held AS (SELECT k, leaf, i, t, count(*) AS c FROM tok GROUP BY ALL),
constant AS (SELECT k, leaf, i, t FROM held JOIN size USING (k, leaf) WHERE c > 1 AND c >= 0.2 * many),
marked AS (
  SELECT tok.*, c.t IS NOT NULL AS fixed FROM tok
  LEFT JOIN constant c ON tok.k = c.k AND tok.leaf = c.leaf AND tok.i = c.i AND tok.t = c.t),
shape AS (
  SELECT k, leaf, m, list(CASE WHEN fixed THEN t END ORDER BY i) AS shape FROM marked
  GROUP BY ALL HAVING count(*) FILTER (WHERE fixed) >= 0.7 * count(*)),
shared_shape AS (SELECT k, leaf, shape, vote, count(DISTINCT t) AS copies FROM shape JOIN n USING (m) GROUP BY ALL),
general AS (
  SELECT k, leaf, shape FROM shared_shape GROUP BY ALL HAVING count(*) >= 3 AND count(*) >= 0.02 * max(copies)),
bad AS (SELECT m FROM exact UNION SELECT m FROM shape SEMI JOIN general USING (k, leaf, shape)),
gone AS (SELECT t, list(DISTINCT i) AS gone FROM n SEMI JOIN bad USING (m) GROUP BY t),
ls AS (SELECT doc_id, text, t, string_split(x, chr(10)) AS ls FROM s)
SELECT doc_id,
       CASE WHEN gone IS NULL THEN text
            ELSE coalesce(array_to_string([ls[j] FOR j IN range(1, len(ls) + 1) IF NOT list_contains(gone, j)], chr(10)), '') END AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines,
       coalesce(len(gone), 0)::BIGINT AS n_dropped
FROM ls LEFT JOIN gone USING (t)
"""
