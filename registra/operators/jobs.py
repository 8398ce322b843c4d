"""Jobs of several stages over records: consensus, promotion, audit, sections, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.operators.windows import best_per, carried, pick_candidates

# Fixed values of the rules.
CONSENSUS_LEAST, CONSENSUS_RATIO, REPAIR_RATIO, LONG_VOWEL_WEIGHT = 3, 3.0, 0.8, 0.25
SHORT_SIGNS, LONG_SIGNS = "ெொ", "ேோாீூ"


def spelling_groups(words: DataFrame, scope: str, value: str, skeleton: Column, confidence: str, short: str = SHORT_SIGNS, long: str = LONG_SIGNS) -> DataFrame:
    """Spellings of each group with one skeleton, ranked: scope, skeleton, the spelling, votes, conf, ``rn``,
    ``runner_up`` and its votes, ``total`` of the group, ``variants``, and ``decisive``.

    Ranked by votes, each long sign adding a quarter, then plain votes, then summed confidence. The first
    is decisive with CONSENSUS_LEAST votes in the group, more votes than the next and CONSENSUS_RATIO
    times as many; if it has a long sign where the next has a short one, REPAIR_RATIO times as many will do.
    Words are counted before their skeletons are formed.
    """
    tally = words.groupBy(scope, value).agg(F.count(F.lit(1)).alias("votes"), F.sum(confidence).alias("conf")).withColumn("skeleton", skeleton).filter("skeleton != ''")
    n_long = F.length(value) - F.length(F.regexp_replace(value, f"[{long}]", ""))
    scored = tally.withColumn("score", F.col("votes") * (1 + LONG_VOWEL_WEIGHT * n_long))
    of = Window.partitionBy(scope, "skeleton")
    way = of.orderBy(F.desc("score"), F.desc("votes"), F.desc("conf"), F.desc(value))
    ranked = scored.withColumns({"rn": F.row_number().over(way), "runner_up": F.lead(value).over(way), "next_votes": F.lead("votes").over(way), "total": F.sum("votes").over(of), "variants": F.count(F.lit(1)).over(of)})
    repair = F.col("runner_up").rlike(f"[{short}]") & F.col(value).rlike(f"[{long}]")
    enough = F.when(repair, F.col("votes") >= REPAIR_RATIO * F.col("next_votes")).otherwise((F.col("votes") > F.col("next_votes")) & (F.col("votes") >= CONSENSUS_RATIO * F.col("next_votes")))
    return ranked.withColumn("decisive", (F.col("rn") == 1) & F.col("runner_up").isNotNull() & (F.col("total") >= CONSENSUS_LEAST) & F.coalesce(enough, F.lit(False)))


def consensus(words: DataFrame, scope: str, value: str, skeleton: Column, confidence: str, short: str = SHORT_SIGNS, long: str = LONG_SIGNS) -> DataFrame:
    """Decisive spelling of each group: scope, skeleton, winner, runner_up, votes, total."""
    groups = spelling_groups(words, scope, value, skeleton, confidence, short, long)
    return groups.filter("decisive").select(scope, "skeleton", F.col(value).alias("winner"), "runner_up", "votes", "total")


def harmonised(fields: DataFrame, winners: DataFrame, scope: str, skeleton: Column, apply: bool = True) -> DataFrame:
    """Fields (scope, original_value, edited_value, ...) with ``suggested_value``, the new ``edited_value`` and
    ``spelling_issue``: where the effective value differs from the winner of its group.

    Originals are never touched; ``apply`` also edits.
    """
    value = F.trim(F.coalesce("edited_value", "original_value", F.lit("")))
    rows = fields.withColumn("_v", value).withColumn("skeleton", skeleton).join(winners.select(scope, "skeleton", "winner"), [scope, "skeleton"], "left")
    odd = F.coalesce((F.col("_v") != "") & (F.col("winner") != F.col("_v")), F.lit(False))
    if apply:
        said = F.concat(F.lit("Spelling harmonised to '"), F.col("winner"), F.lit("' (OCR read '"), F.col("original_value"), F.lit("'); the majority reading across this batch"))
    else:
        said = F.concat(F.lit("Majority spelling across this batch is '"), F.col("winner"), F.lit("' (OCR read '"), F.col("_v"), F.lit("')"))
    out = rows.withColumns({"suggested_value": F.when(odd, F.col("winner")), "spelling_issue": F.when(odd, said)})
    if apply:
        out = out.withColumn("edited_value", F.when(odd, F.col("winner")).otherwise(F.col("edited_value")))
    return out.drop("_v", "skeleton", "winner")


def consensus_report(groups: DataFrame, harmonised_fields: DataFrame) -> DataFrame:
    """One row: groups, those with several spellings, those decided, fields with a suggestion."""
    first = groups.filter("rn = 1")
    n = first.agg(F.count(F.lit(1)).alias("groups_examined"), F.count_if(F.col("variants") > 1).alias("groups_with_conflict"), F.count_if(F.col("decisive")).alias("groups_decided"))
    return n.join(F.broadcast(harmonised_fields.agg(F.count("suggested_value").alias("suggestions"))))


def promote(candidates: DataFrame, current: DataFrame, overwrite: bool = True, only_clean: bool = False) -> DataFrame:
    """One curated row of each identifier with the status of the promotion.

    ``current``: epic, quantity. Overwriting keeps old values where the new one is null. Status:
    inserted, updated, skipped (the row is there and not overwritten) or unchanged.
    """
    scope = candidates.filter(F.col("is_clean") | F.col("is_deleted")) if only_clean else candidates
    picked = pick_candidates(scope).select("epic", "record_id", F.col("quantity").alias("new"), "deleted", F.when(F.col("deleted"), F.col("first_reason")).otherwise("").alias("reason"))
    joined = picked.join(current.select("epic", F.col("quantity").alias("old"), F.lit(True).alias("_there")), "epic", "left")
    there = F.col("_there").isNotNull()
    status = F.when(~there, "inserted").when(F.lit(not overwrite), "skipped").when(F.coalesce("new", "old").eqNullSafe(F.col("old")), "unchanged").otherwise("updated")
    value = F.when(~there, F.col("new")).when(F.lit(not overwrite), F.col("old")).otherwise(F.coalesce("new", "old"))
    return joined.select("epic", "record_id", value.alias("quantity"), "deleted", "reason", status.alias("status"))


def section_names(rows: DataFrame, file: str, section: str, number: Column) -> DataFrame:
    """One name for each section number of a file: most seen, then longest, then greatest."""
    seen = rows.filter(F.trim(section) != "").groupBy(file, number.alias("number"), section).agg(F.count(F.lit(1)).alias("n"))
    return seen.filter("number != ''").groupBy(file, "number").agg(F.max(F.struct("n", F.length(section).alias("len"), section)).getField(section).alias("canonical"))


def reconcile_sections(rows: DataFrame, file: str, page: str, section: str, number: Column) -> DataFrame:
    """Sections by their canonical names, carried to the pages without one; adds ``carried``."""
    names = section_names(rows, file, section, number)
    named = rows.withColumn("number", number).join(names, [file, "number"], "left").withColumn("_own", F.coalesce("canonical", F.col(section)))
    out = carried(named, [file], [F.col(page)], "_own", "reconciled")
    blank = F.trim(F.coalesce(F.col(section), F.lit(""))) == ""
    return out.withColumn("carried", blank & (F.col("reconciled") != "")).drop("number", "canonical", "_own")


def issues(*checks: tuple[Column, str, str]) -> Column:
    """Array of issues (code, severity) of the checks that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for c, code, level in checks]))


def newest(rows: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    return best_per(rows, keys, [F.desc_nulls_last(when), F.col(tie)])


def agreed_readings(readings: DataFrame, cell: str, seq: str, reading: str, low: int = 18, high: int = 120) -> DataFrame:
    """Readings accepted because the first two plausible ones of a cell agree."""
    plausible = readings.filter(F.col(reading).between(low, high))
    way = Window.partitionBy(cell).orderBy(seq, reading)
    first = plausible.withColumn("_rn", F.row_number().over(way)).filter("_rn <= 2")
    two = first.groupBy(cell).agg(F.min(reading).alias("_lo"), F.max(reading).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    return two.filter("_n = 2 and _lo = _hi").select(cell, F.col("_lo").alias(reading))


def route(text: Column, howto: list[str], data: list[str], pleasantries: list[str]) -> Column:
    """Route of a message: data cues first, then how-to, then pleasantries alone; unsure is data."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda cues: F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: low.contains(c))
    words = F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{M}\s]", " "), r"\s+"), lambda w: w != "")
    polite = F.forall(words, lambda w: w.isin(pleasantries))
    return F.when(has(data), "data").when(has(howto), "howto").when(polite, "smalltalk").otherwise("data")


def grounded(replies: DataFrame, id_col: str, text: str, evidence: DataFrame, number: str) -> DataFrame:
    """Replies without the sentences that hold a number absent from the evidence of the reply.

    ``evidence``: id_col and number (text). Sentences stay in order; adds ``dropped``.
    """
    sentences = replies.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+")).alias("pos", "s"))
    numbers = F.array_distinct(F.regexp_extract_all("s", F.lit(r"\d+(?:\.\d+)?"), 0))
    asked = sentences.withColumn("ns", numbers)
    known = evidence.select(id_col, F.col(number).alias("n")).distinct()
    bad = asked.select(id_col, "pos", F.explode("ns").alias("n")).join(known, [id_col, "n"], "left_anti").select(id_col, "pos").distinct().withColumn("_bad", F.lit(True))
    marked = asked.join(bad, [id_col, "pos"], "left")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("_bad").isNull(), F.struct("pos", "s")))), lambda x: x["s"])
    return marked.groupBy(id_col).agg(F.array_join(kept, " ").alias(text), F.count("_bad").alias("dropped"))
