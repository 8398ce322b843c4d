"""Households and families: who in a building is whose parent or spouse.

Every elector declares at most one relative, so links form a functional graph. The rules are those
of a walk from the oldest elector to the youngest, in which each one's link is tried against what was
accepted before; here they are expressed on sets:

* a block is a building of a part, or a chain of near serial numbers where the house is missing;
* the relative is the best match of the declared name in the block, found through an index of names,
  each different name once (``operators.similar``);
* gates refuse what contradicts the roll, a score of 100 points what is not supported;
* marriages are exclusive: in rounds, links that come first at both ends are accepted and what
  touches them goes;
* parents can't be their own descendants: the members of a cycle are found by doubling, and its last
  link goes;
* couples are one node of a forest; doubling with distances gives each its root and its generation.

A tie of names goes to the oldest, then the smallest serial number, then the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.functions import text as X
from registra.operators.similar import matching_names
from registra.operators.storage import dropped, stored

# Fixed values of the rules.
SAME_HOUSE, SAME_BUILDING, NEAR_SERIAL = 30, 22, 15
NAME_POINTS, RELATION_POINTS, AGE_POINTS, GENDER_POINTS = 35, 20, 10, 5
PARENT_GAP, SPOUSE_GAP, ACCEPT, SERIAL_GAP = 18, 35, 60, 15
LEVELS = {95: "Confirmed", 80: "Strong", 60: "Possible"}
MALE, FEMALE = ("male", "m"), ("female", "f")
DIRECTED = ("Father", "Mother", "Husband")
LAST_SERIAL = 10**9

PERSON = ["id", "name", "age", "gender", "serial", "house_key", "building"]


def is_male(gender: Column) -> Column:
    return F.lower(F.trim(F.coalesce(gender, F.lit("")))).isin(*MALE)


def is_female(gender: Column) -> Column:
    return F.lower(F.trim(F.coalesce(gender, F.lit("")))).isin(*FEMALE)


def _known(age: Column) -> Column:
    return F.coalesce(age, F.lit(0))


def _named(name: Column, default: str) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.lit(default))


def gates(relation: Column, age: Column, gender: Column, name: Column, o_age: Column, o_gender: Column, o_name: Column) -> Column:
    """Reason why a link to the other (``o_``) contradicts the roll; null if it does not.

    Unknown ages and genders contradict nothing.
    """
    s, t, txt = _known(age), _known(o_age), lambda c: c.cast("string")
    gap, parent, ages = t - s, relation.isin("Father", "Mother"), (s > 0) & (t > 0)
    older = F.concat(_named(o_name, "The named parent"), F.lit(" ("), txt(t), F.lit(") is not older than "), _named(name, "the child"), F.lit(" ("), txt(s), F.lit("), so cannot be their parent"))
    years = F.when(gap == 1, "year").otherwise("years")
    close = F.concat(
        _named(o_name, "The named parent"), F.lit(" ("), txt(t), F.lit(") is only "), txt(gap), F.lit(" "), years, F.lit(" older than "), _named(name, "the child"), F.lit(" ("), txt(s), F.lit(f"); a parent must be at least {PARENT_GAP} years older")
    )
    other = _named(o_name, "Target")
    apart = F.concat(F.lit("Spouse age gap of "), txt(F.abs(gap)), F.lit(f" years exceeds the {SPOUSE_GAP}-year plausibility limit"))
    wed = relation == "Husband"
    return (
        F.when(~F.coalesce(relation.isin(*DIRECTED), F.lit(False)), "Relation type gives no direction to infer a link from")
        .when(parent & ages & (gap <= 0), older)
        .when(parent & ages & (gap < PARENT_GAP), close)
        .when((relation == "Father") & is_female(o_gender), F.concat(other, F.lit(" is recorded as female but named as a father")))
        .when((relation == "Mother") & is_male(o_gender), F.concat(other, F.lit(" is recorded as male but named as a mother")))
        .when(wed & is_female(o_gender), F.concat(other, F.lit(" is recorded as female but named as a husband")))
        .when(wed & is_male(gender), F.concat(_named(name, "Source"), F.lit(" is recorded as male but declares a husband")))
        .when(wed & ages & (F.abs(gap) > SPOUSE_GAP), apart)
    )


def locality(house: Column, o_house: Column, building: Column, o_building: Column) -> Column:
    same = lambda a, b: (F.coalesce(a, F.lit("")) != "") & F.coalesce(a == b, F.lit(False))
    return F.when(same(house, o_house), SAME_HOUSE).when(same(building, o_building), SAME_BUILDING).otherwise(NEAR_SERIAL)


def link_score(name_score: Column, place: Column, relation: Column, age: Column, gender: Column, o_age: Column, o_gender: Column) -> Column:
    """0 to 100 for a link that passed the gates: locality, name, a recorded relation, ages and genders
    that were there to be checked."""
    s, t = _known(age), _known(o_age)
    ages = (s > 0) & (t > 0) & F.when(relation == "Husband", F.abs(t - s) <= SPOUSE_GAP).otherwise(t - s >= PARENT_GAP)
    sexes = F.when(relation == "Father", is_male(o_gender)).when(relation == "Mother", is_female(o_gender)).otherwise(is_male(o_gender) & is_female(gender))
    points = F.bround(name_score * NAME_POINTS, 0).cast("int") + F.when(relation.isin(*DIRECTED), RELATION_POINTS).otherwise(0)
    points = points + F.when(ages, AGE_POINTS).otherwise(0) + F.when(sexes, GENDER_POINTS).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), place + points))


def level(score: Column) -> Column:
    out = None
    for least, name in LEVELS.items():
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("Unverified")


def serial_chains(rows: DataFrame, part: str, serial: str, gap: int = SERIAL_GAP, out: str = "chain") -> DataFrame:
    """Number of the chain of a row in its part: a new one where the serial numbers jump by more than ``gap``.

    Only the different numbers of a part are ordered. Rows without a number are in the first chain.
    """
    seen = rows.filter(F.col(serial).isNotNull()).select(part, serial).distinct()
    way = Window.partitionBy(part).orderBy(serial)
    seen = seen.withColumn("_jump", F.when(F.col(serial) - F.lag(serial).over(way) > gap, 1).otherwise(0))
    seen = seen.select(F.col(part).alias("_part"), F.col(serial).alias("_serial"), F.sum("_jump").over(way).alias(out))
    found = rows.join(seen, F.col(part).eqNullSafe(F.col("_part")) & (F.col(serial) == F.col("_serial")), "left").drop("_part", "_serial")
    return found.withColumn(out, F.coalesce(out, F.lit(0)))


def households(people: DataFrame) -> DataFrame:
    """``people`` with ``block``, ``house_key`` and ``building``.

    people: id, part_number, serial, name, relation_type, relation_name, age, gender, house_number.
    """
    keyed = people.withColumns({"house_key": X.normal_house(F.col("house_number")), "building": X.building_key(F.col("house_number"))})
    part = F.coalesce("part_number", F.lit(""))
    housed = keyed.filter("building is not null").withColumn("block", F.concat_ws("|", F.lit("house"), part, "building"))
    near = serial_chains(keyed.filter("building is null"), "part_number", "serial")
    near = near.withColumn("block", F.concat_ws("|", F.lit("serial"), part, "chain")).drop("chain")
    return housed.unionByName(near)


def _order(prefix: str = "") -> list[Column]:
    """Oldest first; unknown ages last."""
    return [(-_known(F.col(f"{prefix}age"))).alias("o1"), F.coalesce(f"{prefix}serial", F.lit(LAST_SERIAL)).alias("o2"), F.col(f"{prefix}id").alias("o3")]


def declared_links(people: DataFrame) -> DataFrame:
    """The best relative of each elector in the block: block, source, target, relation, score, the order of
    the source, and ``reason`` and ``gated`` where the gates refuse it.

    people: as ``households`` returns it.
    """
    people = people.withColumns({"_clean": X.clean_name(F.col("name")), "_wanted": X.clean_name(F.col("relation_name")), "relation": F.initcap(F.coalesce("relation_type", F.lit("")))})
    asking = people.filter("_wanted != ''").select("block", F.col("_wanted").alias("wanted")).distinct()
    # of each different name of a block the first two electors are enough: one may be the asking one
    way = Window.partitionBy("block", "_clean").orderBy(*_order())
    first = people.filter("_clean != ''").withColumn("_rn", F.row_number().over(way)).filter("_rn <= 2")
    first = stored(first.select("block", F.col("_clean").alias("name_key"), F.struct(*_order(), *PERSON).alias("who")), "named", large=True)
    names = first.select("block", "name_key").distinct()
    scored = matching_names(asking, names, ["block"], "wanted", "name_key")
    found = scored.join(first, ["block", "name_key"]).select("block", "wanted", "score", "who")
    way = Window.partitionBy("block", "wanted").orderBy(F.desc("score"), "who.o1", "who.o2", "who.o3")
    found = found.withColumn("_rn", F.row_number().over(way)).filter("_rn <= 2")
    two = found.groupBy("block", "wanted").agg(F.min_by(F.struct("score", "who"), "_rn").alias("a"), F.max_by(F.struct("score", "who"), "_rn").alias("b"), F.count(F.lit(1)).alias("n"))
    own = F.col("a.who.id") == F.col("id")
    chosen = people.filter("_wanted != ''").join(two.withColumnRenamed("wanted", "_wanted"), ["block", "_wanted"])
    chosen = chosen.withColumn("_c", F.when(~own, F.col("a")).when(F.col("n") > 1, F.col("b"))).filter("_c is not null")
    # a table of plain columns: each rule below names many of them
    chosen = stored(chosen.select("block", "relation", *PERSON, F.struct(*_order()).alias("order"), "_c.score", *[F.col(f"_c.who.{c}").alias(f"o_{c}") for c in PERSON]), "chosen", large=True)
    me, o = ({c: F.col(p + c) for c in PERSON} for p in ("", "o_"))
    reason = gates(F.col("relation"), me["age"], me["gender"], me["name"], o["age"], o["gender"], o["name"])
    place = locality(me["house_key"], o["house_key"], me["building"], o["building"])
    score = link_score(F.col("score"), place, F.col("relation"), me["age"], me["gender"], o["age"], o["gender"])
    out = chosen.select("block", F.col("id").alias("source"), o["id"].alias("target"), "relation", score.alias("score"), "order", reason.alias("reason"), reason.isNotNull().alias("gated"), F.col("name").alias("source_name"), o["name"].alias("target_name"))
    out = stored(out, "declared", large=True)
    dropped(first, chosen)
    return out


def exclusive(links: DataFrame) -> DataFrame:
    """Marriages (source, target, order) taken in order, each of which holds both its partners."""
    rest, kept = stored(links.select("source", "target", "order"), "proposals", large=True), []
    while rest.limit(1).count():
        ends = rest.select(F.explode(F.array("source", "target")).alias("who"), "order").groupBy("who").agg(F.min("order").alias("first"))
        at = lambda c: ends.select(F.col("who").alias(c), F.col("first").alias(f"_{c}"))
        marked = rest.join(at("source"), "source").join(at("target"), "target")
        won = stored(marked.filter((F.col("order") == F.col("_source")) & (F.col("order") == F.col("_target"))).select("source", "target", "order"), "married", large=True)
        taken = won.select(F.explode(F.array("source", "target")).alias("who"))
        left = rest.join(taken, F.col("source") == F.col("who"), "left_anti").join(taken, F.col("target") == F.col("who"), "left_anti")
        left = stored(left, "proposals", large=True)
        dropped(rest)
        kept.append(won)
        rest = left
    dropped(rest)
    out = links.select("source", "target", "order").limit(0)
    for won in kept:
        out = out.unionByName(won)
    return out


def chased(nodes: DataFrame) -> DataFrame:
    """Where the pointers of nodes (node, up) end: ``root`` and ``steps`` there, both null for those
    that never end. Doubling: as many rounds as the logarithm of the longest way.
    """
    far = nodes.select("node", F.col("up").alias("far"), F.coalesce("up", "node").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("steps"))
    far, before = stored(far, "pointers", large=True), -1
    while True:
        n = far.filter("far is not null").count()
        # each round ends some ways, unless all that are left lead into rings
        if n in (0, before):
            break
        before = n
        on = far.select(F.col("node").alias("_n"), F.col("far").alias("_f"), F.col("root").alias("_e"), F.col("steps").alias("_s"))
        step = far.filter("far is not null").join(on, F.col("far") == F.col("_n"), "left")
        step = step.select("node", F.col("_f").alias("far"), F.coalesce("_e", "root").alias("root"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"))
        step = stored(step.unionByName(far.filter("far is null")), "pointers", large=True)
        dropped(far)
        far = step
    ended = F.col("far").isNull()
    out = stored(far.select("node", F.when(ended, F.col("root")).alias("root"), F.when(ended, F.col("steps")).alias("steps")), "chased", large=True)
    dropped(far)
    return out


def ring_members(nodes: DataFrame) -> DataFrame:
    """(node, ring) of the nodes (node, up) that come back to themselves; ring: its smallest node.

    What can be reached by many steps grows fewer with each doubling, as long as it holds more than rings.
    """
    far, before = stored(nodes.select("node", "up"), "hops", large=True), -1
    while True:
        hop = far.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        step = stored(far.join(hop, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up")).filter("up is not null"), "hops", large=True)
        dropped(far)
        far = step
        ends = far.select(F.col("up").alias("node")).distinct()
        n = ends.count()
        if n == 0 or n == before:
            break
        before = n
    on = stored(nodes.join(ends, "node", "left_semi"), "ringed", large=True)
    ring = components(on, "node", "up") if on.limit(1).count() else on.select(F.col("node").alias("id"), F.col("up").alias("family"))
    out = stored(ring.select(F.col("id").alias("node"), F.col("family").alias("ring")), "rings", large=True)
    dropped(far, on)
    return out


def decided(links: DataFrame) -> DataFrame:
    """``links`` with the final ``reason``; those without one are accepted.

    In the order of the walk: gates, then cycles of parents, then marriages, then the score.
    """
    weak = F.col("score") < ACCEPT
    passed = links.filter("reason is null")
    parents = passed.filter("relation in ('Father', 'Mother')")
    rings = ring_members(parents.select(F.col("source").alias("node"), F.col("target").alias("up")))
    # the last link of a cycle meets all the others, unless one of them was too weak to be there
    ringed = parents.join(rings, F.col("source") == F.col("node")).select("source", "ring", "order", weak.alias("weak"))
    last = ringed.groupBy("ring").agg(F.max_by(F.struct("source", "weak"), "order").alias("l"), F.sum(F.col("weak").cast("int")).alias("weak"))
    cyclic = last.filter((F.col("weak") == 0) | ((F.col("weak") == 1) & F.col("l.weak"))).select(F.col("l.source").alias("source"), F.lit(True).alias("cycle"))
    wed = passed.filter("relation = 'Husband'")
    married = stored(exclusive(wed.filter(~weak)), "marriages", large=True)
    partner = married.select(F.explode(F.array(F.struct("source", F.col("target").alias("with"), "order"), F.struct(F.col("target").alias("source"), F.col("source").alias("with"), "order"))).alias("m")).select(F.col("m.source").alias("who"), F.col("m.with").alias("with"), F.col("m.order").alias("since"))
    names = links.select(F.col("source").alias("n"), F.col("source_name").alias("name")).unionByName(links.select(F.col("target").alias("n"), F.col("target_name").alias("name"))).distinct().groupBy("n").agg(F.max("name").alias("name"))
    partner = partner.join(names, F.col("with") == F.col("n")).select("who", "since", F.col("name").alias("partner"))
    own = partner.select(F.col("who").alias("source"), F.col("since").alias("s_since"), F.col("partner").alias("s_partner"))
    other = partner.select(F.col("who").alias("target"), F.col("since").alias("t_since"), F.col("partner").alias("t_partner"))
    out = links.join(cyclic, "source", "left").join(own, "source", "left").join(other, "target", "left")
    taken = lambda since: F.coalesce(F.col(since) < F.col("order"), F.lit(False)) & (F.col("relation") == "Husband")

    def held(name: str, partner_name: str) -> Column:
        return F.concat(_named(F.col(name), "That elector"), F.lit(" is already recorded as married to "), _named(F.col(partner_name), "another elector"), F.lit("; a second marriage cannot be inferred from the roll"))

    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("cycle"), F.concat(F.lit("Linking "), _named(F.col("target_name"), "the named parent"), F.lit(" as parent would make them their own descendant")))
        .when(taken("s_since"), held("source_name", "s_partner"))
        .when(taken("t_since"), held("target_name", "t_partner"))
        .when(weak, F.concat(F.lit("Evidence scores only "), F.col("score").cast("string"), F.lit(f"/100, below the {ACCEPT} threshold")))
    )
    out = stored(out.select(*[c for c in links.columns if c != "reason"], reason.alias("reason")), "decided", large=True)
    dropped(rings, married)
    return out


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, family): the smallest id that each linked id is connected with."""
    both = stored(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges", large=True)
    label = stored(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.min("x")).alias("family")), "label", large=True)
    while True:
        near = both.join(label, F.col("y") == F.col("id")).groupBy("x").agg(F.min("family").alias("near"))
        step = label.join(near, F.col("id") == F.col("x")).select("id", F.least("family", "near").alias("to"), F.col("family").alias("was"))
        jump = step.select(F.col("id").alias("_j"), F.col("to").alias("_far"))
        step = stored(step.join(jump, F.col("to") == F.col("_j")).select("id", F.least("to", "_far").alias("family"), "was"), "label", large=True)
        dropped(label)
        label = step.select("id", "family")
        label.scratch = step.scratch
        if step.filter("family != was").limit(1).count() == 0:
            dropped(both)
            return label


def role(gender: Column, has_parent: Column, has_child: Column, has_spouse: Column) -> Column:
    by = lambda male, female, unknown: F.when(is_female(gender), female).when(is_male(gender), male).otherwise(unknown)
    return F.when(has_parent, by("Son", "Daughter", "Child")).when(has_child, by("Father", "Mother", "Parent")).when(has_spouse, by("Husband", "Wife", "Spouse")).otherwise("Resident")


def families(people: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Each elector with block, family (its smallest id), role, generation, whether it heads the family,
    spouse_id, parent_id, the confidence of the family with its level, and why nothing was resolved.

    people: as for ``households``; links: what ``decided`` gives for them, if it is there already.
    An elector without links is a family of its own. An empty table gives no rows.
    """
    people = stored(households(people), "people", large=True)
    own_links = links is None
    if own_links:
        declared = declared_links(people)
        links = decided(declared)
        dropped(declared)
    kept = links.filter("reason is null")
    parent = kept.filter("relation != 'Husband'").select(F.col("source").alias("id"), F.col("target").alias("parent_id"))
    wed = kept.filter("relation = 'Husband'")
    spouse = wed.select(F.col("source").alias("id"), F.col("target").alias("spouse_id")).unionByName(wed.select(F.col("target").alias("id"), F.col("source").alias("spouse_id")))
    children = parent.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    out = people.select("id", "block", "gender", *_order(), (X.clean_name(F.col("relation_name")) != "").alias("declares"))
    for more in (parent, spouse, children):
        out = out.join(more, "id", "left")
    # a couple is one node, led by its smaller id
    out = stored(out.withColumn("node", F.least("id", "spouse_id")), "kin", large=True)
    ups = out.filter("parent_id is not null").select("node", F.col("parent_id").alias("p")).join(out.select(F.col("id").alias("p"), F.col("node").alias("up")), "p").select("node", "up")
    # only the wife's record names the husband, so a couple has one parent at most
    nodes = out.select("node").distinct().join(ups, "node", "left")
    nodes = stored(nodes, "nodes", large=True)
    way = chased(nodes)
    # a couple that is its own ancestor leaves its component without a root: the oldest member stands in
    unended = way.filter("root is null").select("node")
    lost = nodes.join(unended, "node", "left_semi")
    if lost.limit(1).count():
        lost = components(lost, "node", "up").select(F.col("id").alias("node"), F.col("family").alias("ring"))
    else:
        lost = unended.select("node", F.col("node").alias("ring"))
    oldest = out.join(lost, "node").groupBy("ring").agg(F.min_by("node", F.struct("o1", "o2", "o3")).alias("node"))
    cut = nodes.join(lost, "node", "left_semi").join(oldest.select("node", F.lit(True).alias("head")), "node", "left")
    again = chased(cut.select("node", F.when(F.col("head"), F.lit(None)).otherwise(F.col("up")).alias("up"))).select("node", F.col("steps").alias("again"), F.col("root").alias("top"))
    way = way.join(lost, "node", "left").join(again, "node", "left").join(oldest.select(F.col("ring").alias("_r"), F.col("node").alias("_old")), F.col("ring") == F.col("_r"), "left")
    placed = way.select("node", F.coalesce("root", "_old").alias("root"), (F.coalesce("steps", F.when(F.col("top") == F.col("_old"), F.col("again")), F.lit(0)) + 1).alias("generation"), F.col("ring").isNotNull().alias("ringed"))
    out = out.join(placed, "node")
    # the head is the partner with more children, the older one, the first on the roll
    top = out.filter(F.col("node") == F.col("root"))
    first = F.struct(F.when(F.col("ringed"), 0).otherwise(-F.coalesce("children", F.lit(0))).alias("c"), "o1", "o2", "o3")
    head = top.groupBy("root").agg(F.min_by("id", first).alias("head"))
    family = out.groupBy("root").agg(F.min("id").alias("family"), F.max("generation").alias("generations"), F.max("declares").alias("declares"))
    scored = kept.select(F.col("source").alias("id"), "score", F.lit(False).alias("bad")).unionByName(links.filter("reason is not null").select(F.col("source").alias("id"), F.lit(None).cast("int").alias("score"), F.lit(True).alias("bad")))
    sure = scored.join(out.select("id", "root"), "id").groupBy("root").agg(F.bround(F.avg("score"), 0).cast("int").alias("sure"), F.max("bad").alias("bad"))
    out = out.join(family.withColumnRenamed("declares", "any_declares").join(head, "root").join(sure, "root", "left"), "root")
    confidence = F.coalesce("sure", F.lit(0))
    why = F.when(F.col("sure").isNull(), F.when(F.col("bad"), "contradicted").when(F.col("any_declares"), "relative_not_in_household").otherwise("no_relation_recorded"))
    return out.select(
        "id", "block", "family",
        role(F.col("gender"), F.col("parent_id").isNotNull(), F.col("children").isNotNull(), F.col("spouse_id").isNotNull()).alias("role"),
        "generation", "generations", (F.col("id") == F.col("head")).alias("is_head"), "spouse_id", "parent_id",
        confidence.alias("confidence"), level(confidence).alias("level"), why.alias("unresolved"),
    )


def household_of(people: DataFrame, target: int, limit: int | None = None) -> DataFrame:
    """The household of one elector: its members in the order of the roll with family and role, whether
    they are of the elector's own family, the spellings of the address and whether ``limit`` cut it.

    Only the elector's building is resolved, or the serial numbers around it where its house is missing.
    ``limit``: members of the household that are looked at, as the report shows no more; the elector is always among them.
    """
    own = people.filter(F.col("id") == target).select(F.col("part_number").alias("_part"), F.col("serial").alias("_serial"), X.building_key(F.col("house_number")).alias("_building"))
    own = F.broadcast(own.limit(1))
    near = F.col("serial").between(F.greatest(F.lit(1), F.col("_serial") - SERIAL_GAP), F.col("_serial") + SERIAL_GAP)
    same = F.when(F.col("_building").isNotNull(), X.building_key(F.col("house_number")) == F.col("_building")).otherwise(near)
    part = F.coalesce(F.col("part_number"), F.lit("")).eqNullSafe(F.coalesce("_part", F.lit("")))
    found = people.join(own, part & (same | (F.col("id") == target))).drop("_part", "_serial", "_building")
    total = found.count() if limit is not None else 0
    if limit is not None and total > limit:
        kept = found.filter(F.col("id") != target).orderBy("serial", "id").limit(limit - 1)
        found = kept.unionByName(found.filter(F.col("id") == target))
    members = stored(found, "household")
    out = families(members)
    family = F.broadcast(out.filter(F.col("id") == target).select(F.col("family").alias("_own")))
    spelled = F.broadcast(members.agg(F.array_sort(F.collect_set(F.when(F.trim("house_number") != "", F.trim("house_number")))).alias("spellings")))
    out = out.join(family).join(spelled)
    cut = F.lit(limit is not None and total > limit)
    return out.select("id", "family", "role", "generation", "is_head", "confidence", "level", (F.col("family") == F.col("_own")).alias("own_family"), F.concat_ws(", ", "spellings").alias("spellings"), cut.alias("truncated"))
