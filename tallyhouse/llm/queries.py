"""Queries of the text and statistics operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions.clean import fold, postcode
from tallyhouse.llm import bpe, linkage, mixing, percentiles, subjects, variants
from tallyhouse.operators import joins
from tallyhouse.plans.catalogue import Catalogue, table
from tallyhouse.session import staged

C = Catalogue()
CATALOGUES = [C]

# --- percentiles ------------------------------------------------------------------------------------------------------

MEASURES = ("revenue_reserve", "total_expenditure")

_P5_VALUES = """
WITH known AS (
  SELECT urn, period_end, loaded_at, la, year,
    CASE WHEN NOT coalesce(list_contains(suspect, 'revenue_reserve'), false) THEN revenue_reserve END AS rr,
    CASE WHEN NOT coalesce(list_contains(suspect, 'total_expenditure'), false) THEN total_expenditure END AS te
  FROM finance_history WHERE urn IS NOT NULL AND period_end IS NOT NULL),
resolved AS (
  SELECT la, try_cast(left(year, 4) AS INTEGER) AS start_year, rr, te FROM known
  QUALIFY row_number() OVER (PARTITION BY urn, period_end ORDER BY loaded_at DESC NULLS LAST, la DESC NULLS LAST,
    year DESC NULLS LAST, rr DESC NULLS LAST, te DESC NULLS LAST) = 1),
v AS (
  SELECT la, start_year, 'revenue_reserve' AS measure, rr AS value FROM resolved
  UNION ALL
  SELECT la, start_year, 'total_expenditure', te FROM resolved),
ranked AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY la, start_year, measure) AS n FROM v
  WHERE value IS NOT NULL AND la IS NOT NULL AND start_year IS NOT NULL
  WINDOW w AS (PARTITION BY la, start_year, measure ORDER BY value))
"""


def finance_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(la, start_year, measure, value) of the returns that count: the latest load of each urn and period, no suspect field."""
    # A copy of a return is in the authority or the year that its latest load says, so the latest is found first.
    pick = F.struct("loaded_at", F.col("la"), F.col("year"), *[F.when(~F.coalesce(F.array_contains("suspect", m), F.lit(False)), F.col(m)).alias(m) for m in MEASURES])
    raw = table(spark, sf_dir, "finance_history").where("urn is not null and period_end is not null")
    last = raw.groupBy("urn", "period_end").agg(F.max(pick).alias("r"))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"r.{m}").alias("value")) for m in MEASURES]))
    rows = last.select(F.col("r.la").alias("la"), F.substring("r.year", 1, 4).try_cast("int").alias("start_year"), pairs.alias("m"))
    return rows.select("la", "start_year", "m.measure", "m.value").where("value is not null and la is not null and start_year is not null")


@C.query(
    "p5_found",
    _P5_VALUES
    + """SELECT la, start_year, measure FROM ranked WHERE (measure = 'revenue_reserve' AND rn = greatest(1, ceil(n / 2)) AND value < 0)
  OR (measure = 'total_expenditure' AND rn = greatest(1, ceil(n * 9 / 10)) AND value > 8000000)""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities and years whose median reserve is below 0, or whose 90th percentile of expenditure is above 8,000,000."""
    q = percentiles.multi_select(
        finance_values(spark, sf_dir), ["la", "start_year", "measure"],
        {"revenue_reserve": [0.5], "total_expenditure": [0.9]}, of="measure",
    )
    low = (F.col("measure") == "revenue_reserve") & (F.col("value") < 0)
    high = (F.col("measure") == "total_expenditure") & (F.col("value") > 8_000_000)
    return q.where(low | high).select("la", "start_year", "measure")


@C.query(
    "p5_percentiles",
    _P5_VALUES
    + """SELECT la, start_year, measure, share, n, value FROM ranked, (VALUES (0.1, 1), (0.5, 5), (0.9, 9)) q(share, tenths)
WHERE rn = greatest(1, ceil(n * tenths / 10))""",
)
def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10th, 50th and 90th percentile of both measures per authority and year."""
    return percentiles.multi_select(finance_values(spark, sf_dir), ["la", "start_year", "measure"], [0.1, 0.5, 0.9])


@C.query("p5_merged")
def p5_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per authority over all years, from one summary a year with a rank error of 5 %."""
    kept = percentiles.summaries(finance_values(spark, sf_dir), ["la", "measure"], "start_year", 0.05)
    return percentiles.merged(kept, ["la", "measure"], [0.1, 0.5, 0.9])


@C.query(
    "p5_merged_within",
    _P5_VALUES + "SELECT la, measure, share, true AS within FROM (SELECT DISTINCT la, measure FROM ranked), (VALUES (0.1), (0.5), (0.9)) q(share)",
)
def p5_merged_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the merged percentiles of each authority lie within the stated rank error of 5 % of all its values."""
    values = finance_values(spark, sf_dir)
    got = percentiles.merged(percentiles.summaries(values, ["la", "measure"], "start_year", 0.05), ["la", "measure"], [0.1, 0.5, 0.9])
    met = values.select("la", "measure", F.col("value").alias("v")).join(got, ["la", "measure"])
    ranks = met.groupBy("la", "measure", "share", "n").agg(F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    low, high = F.col("below") + 1, F.col("upto")  # the ranks that the value given has
    wanted = percentiles.wanted_rank(F.col("share"), F.col("n"))
    return ranks.select("la", "measure", "share", (F.greatest(low - wanted, wanted - high, F.lit(0)) <= 0.05 * F.col("n") + 1).alias("within"))


# --- tokens -----------------------------------------------------------------------------------------------------------


@C.query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@C.query("p7_totals")
def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of each source."""
    docs = table(spark, sf_dir, "documents").select(mixing.source_key(F.col("source")).alias("source"), "text")
    sized = bpe.encode_column(docs, "text", out="tokens", lengths_only=True)
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


# --- mixture ----------------------------------------------------------------------------------------------------------


def sized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens) of one document per different text, written to the shared folder."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(
        "doc_id", mixing.source_key(F.col("source")).alias("source"), "text",
        F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"),
    )
    sized = bpe.encode_column(docs, "text", out="tokens", lengths_only=True).where("tokens > 0")
    named = table(spark, sf_dir, "mix_target").select(mixing.source_key(F.col("source")).alias("source")).distinct()
    return staged(mixing.one_text_each(sized.join(F.broadcast(named), "source", "left_semi")), "sized")


@C.query("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen for the mixture and how often each is used."""
    texts = sized_texts(spark, sf_dir)
    plan = mixing.plan_mixture(texts, table(spark, sf_dir, "mix_target"))
    return mixing.uses(mixing.placed(texts, plan))


@C.query(
    "p8_targets",
    """WITH k AS (SELECT trim(regexp_replace(lower(trim(source)), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS source, weight, max_repeats FROM mix_target WHERE weight > 0 AND max_repeats > 0),
t AS (SELECT source, sum(weight) AS weight, min(max_repeats) AS max_repeats FROM k WHERE source <> '' GROUP BY source)
SELECT source, weight, CAST(max_repeats AS INTEGER) AS max_repeats, true AS near, true AS capped FROM t""",
)
def p8_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source reaches its target share to a few blocks and longest texts, and none is repeated too often."""
    texts, targets = sized_texts(spark, sf_dir), table(spark, sf_dir, "mix_target")
    plan = mixing.plan_mixture(texts, targets)
    longest = texts.agg(F.coalesce(F.max("tokens"), F.lit(0)).alias("longest"))
    r = mixing.reached(mixing.uses(mixing.placed(texts, plan)), plan, targets).join(F.broadcast(longest))
    slack = (4 * plan.block + 2 * F.col("longest")) / F.lit(float(max(1, plan.total)))
    return r.select("source", "weight", "max_repeats", (F.abs(F.col("reached_share") - F.col("target_share")) <= slack).alias("near"), (F.col("most_uses") <= F.col("max_repeats")).alias("capped"))


@C.query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of all tokens of every source of the targets."""
    texts, targets = sized_texts(spark, sf_dir), table(spark, sf_dir, "mix_target")
    plan = mixing.plan_mixture(texts, targets)
    return mixing.reached(mixing.uses(mixing.placed(texts, plan)), plan, targets)


@C.query("p8_order")
def p8_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document with its place in the mixture."""
    texts = sized_texts(spark, sf_dir)
    plan = mixing.plan_mixture(texts, table(spark, sf_dir, "mix_target"))
    w = Window.partitionBy("slot").orderBy("start")
    return mixing.placed(texts, plan).select("slot", F.row_number().over(w).alias("place"), "doc_id", "source", "turn")

# --- names ------------------------------------------------------------------------------------------------------------


def open_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(urn, name, phase, la_code, town, pc, outward, website, open_date) of every way a school open now is written."""
    est = table(spark, sf_dir, "establishment").where(fold(F.col("status")).startswith("open") & F.col("urn").isNotNull())
    return est.select(
        "urn", "name", "phase", "la_code", "town", postcode(F.col("postcode")).alias("pc"), "website", "open_date"
    ).withColumn("outward", F.split_part("pc", F.lit(" "), F.lit(1)))


def successors(spark: SparkSession, sf_dir: str, hops: int = 3) -> DataFrame:
    """(former, urn): the open school that took the place of a former one.

    From the resolved list; for former schools it lacks, the one open school at the same postcode that opened between a
    month before and 400 days after the former one closed.  A former school with neither follows the one school, closed
    since, that took its place so, and what took that one's, over at most ``hops`` links.
    """
    est = table(spark, sf_dir, "establishment").where("urn is not null").select("urn", "status", postcode(F.col("postcode")).alias("pc"), "open_date", "close_date")
    listed = table(spark, sf_dir, "school_match").select(F.explode("former_urns").alias("former"), "urn").where("former is not null and former <> urn")
    shut = est.where(fold(F.col("status")) == "closed").select(F.col("urn").alias("former"), "pc", "close_date").distinct()
    gap = F.datediff("open_date", "close_date").between(-31, 400)

    def only(left: DataFrame, right: DataFrame) -> DataFrame:
        hit = left.join(right.select("urn", "pc", "open_date").distinct(), "pc").where(gap & (F.col("urn") != F.col("former")))
        one = hit.groupBy("former").agg(F.min("urn").alias("urn"), F.max("urn").alias("_other"))
        return one.where(F.col("urn") == F.col("_other")).drop("_other")

    now = est.where(fold(F.col("status")).startswith("open"))
    direct = listed.unionByName(only(shut, now).join(listed, "former", "left_anti")).distinct()
    direct = staged(direct, "direct")
    left = shut.join(direct, "former", "left_anti")
    steps = staged(only(left, est.where(fold(F.col("status")) == "closed")).unionByName(direct), "steps")
    far = joins.chains(steps, "former", "urn", hops).where("hops > 1").join(now.select(F.col("urn").alias("reached")).distinct(), "reached", "left_semi")
    far = far.join(direct, far.start == direct.former, "left_anti").groupBy("start").agg(F.min_by("reached", F.struct("hops", "reached")).alias("urn"))
    return staged(direct.unionByName(far.withColumnRenamed("start", "former")).distinct(), "successors")


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, name, phase, place, la_code, outward): present and earlier names of every open school."""
    now = open_schools(spark, sf_dir)
    here = now.groupBy("urn").agg(
        F.max("la_code").alias("la_code"), F.max("outward").alias("outward"), F.max("town").alias("place"), F.max("phase").alias("phase")
    )
    listed = table(spark, sf_dir, "school_match").select("urn", F.explode("former_names").alias("name"))
    shut = table(spark, sf_dir, "establishment").select(F.col("urn").alias("former"), "name", F.col("phase").alias("old"))
    gone = shut.join(successors(spark, sf_dir), "former").select("urn", "name", "old")
    old = listed.withColumn("old", F.lit(None).cast("string")).unionByName(gone)
    every = now.select("urn", "name", F.col("phase").alias("own")).unionByName(old.withColumnRenamed("old", "own")).where("name is not null")
    return every.distinct().join(here.drop("phase"), "urn").select(
        F.col("urn").alias("target"), "name", F.col("own").alias("phase"), "place", "la_code", "outward"
    )


@C.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The school that each name in the admissions booklets means."""
    typed = table(spark, sf_dir, "admission_name").where("mention_id is not null").groupBy("mention_id").agg(
        F.max_by(F.struct("la_code", "phase", "outward", "printed_name"), F.struct("read_at", "printed_name")).alias("m")
    )
    out = F.regexp_replace(F.upper("m.outward"), "[^A-Z0-9]", "")
    la = F.col("m.la_code").cast("string")
    typed = typed.select(
        F.col("mention_id").alias("id"), F.col("m.printed_name").alias("name"), F.col("m.phase").alias("phase"),
        F.array_compact(F.array(F.concat_ws("|", la, out), F.concat(la, F.lit("|")))).alias("blocks"),
    )
    known = known_names(spark, sf_dir).withColumn(
        "blocks", F.array(F.concat(F.col("la_code").cast("string"), F.lit("|"), F.coalesce("outward", F.lit(""))))
    )
    return variants.link_variants(typed, known).select(F.col("id").alias("mention_id"), F.col("target").alias("urn"))


# --- associations -----------------------------------------------------------------------------------------------------

#: Fixed value: how the objects of parents' associations name their school.
OBJECTS = r"(?i)(?:pupils (?:in|of|at)|children who attend|money for|benefit of|pupils attending)\s+(.+?)(?:,?\s+and to bring|,?\s+by (?:giving|providing)|\s+and hold|[.;]|$)"

VOTES = ["v_name", "v_kind", "v_addr", "v_obj", "v_pc", "v_web", "v_mail", "v_place", "v_best"]


def host(c: Column) -> Column:
    """The host of a web address or the part of a mail address after the @, without www."""
    t = F.lower(F.trim(c))
    t = F.regexp_replace(F.regexp_replace(t, "^[a-z]+://", ""), "^.*@", "")
    return F.nullif(F.regexp_replace(F.regexp_extract(t, r"^([a-z0-9.-]+)", 1), r"^www\.", ""), F.lit(""))


def association_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(charity_number, urn, confidence, score, plural, joined, has, votes): candidate pairs of associations and open schools.

    Candidates share a postcode, a host, or enough letter q-grams of a name in the same place.
    """
    las = table(spark, sf_dir, "local_authority").select("la_code", fold(F.col("name")).alias("la_name"))
    known = known_names(spark, sf_dir).join(F.broadcast(las), "la_code", "left")
    tag = lambda kind, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{kind}|"), c))
    known = known.withColumn(
        "blocks", F.array_compact(F.array(tag("o", F.col("outward")), tag("t", fold(F.col("place"))), tag("n", F.col("la_name"))))
    ).dropDuplicates(["target", "name", "phase"]).withColumn("id", F.monotonically_increasing_id())
    known = staged(known.withColumn("p", variants.parsed("name")).select("id", "target", "name", "phase", "place", "la_name", "blocks", "p.*"), "known")
    weights = variants.word_weights(known)

    pta = table(spark, sf_dir, "pta").where("charity_number is not null")
    latest = F.struct("date_of_registration", "charity_name", "charity_contact_address1", "charitable_objects")
    fields = ["charity_name", "charity_contact_postcode", "charity_contact_web", "charity_contact_email", "charity_contact_address1",
              "charity_contact_address2", "charity_contact_address3", "charitable_objects", "area_of_benefit"]
    one = pta.groupBy("charity_number").agg(F.max_by(F.struct(*fields), latest).alias("c")).select("charity_number", "c.*")
    addr = F.nullif(F.regexp_extract("charity_contact_address1", r"(?i)^\s*c\s*/?\s*o\b\.?\s*(.+)$", 1), F.lit(""))
    obj = F.nullif(F.trim(F.regexp_extract("charitable_objects", OBJECTS, 1)), F.lit(""))
    obj_name = F.when(~F.lower(obj).rlike("^the school\\b"), F.split_part(obj, F.lit(","), F.lit(1)))
    ch = one.withColumn("n", linkage.charity_name("charity_name")).where("n.named is not null").select(
        F.col("charity_number").alias("id"), "n.*", postcode(F.col("charity_contact_postcode")).alias("pc"),
        host(F.col("charity_contact_web")).alias("web"), host(F.col("charity_contact_email")).alias("mail"),
        variants.parsed(addr).alias("a"), variants.parsed(obj_name).alias("o"), linkage.partners(obj_name).alias("two"),
        F.array_compact(F.array(
            fold(F.col("charity_contact_address2")), fold(F.col("charity_contact_address3")), fold(F.col("area_of_benefit")),
            fold(F.element_at(F.split(obj, ","), -1)), fold(F.when(F.col("charity_name").contains(","), F.element_at(F.split("charity_name", ","), -1))),
        )).alias("places"),
    )
    ch = ch.withColumn("outward", F.split_part("pc", F.lit(" "), F.lit(1))).withColumn(
        "blocks",
        F.array_distinct(F.array_compact(F.concat(
            F.array(tag("o", F.col("outward"))), F.transform("places", lambda p: F.concat(F.lit("t|"), p)), F.transform("places", lambda p: F.concat(F.lit("n|"), p)),
        ))),
    )
    ch = staged(ch.select(
        "id", "named", "core", "kinds", (F.col("plural") | F.col("two.plural")).alias("plural"), F.array_union("joined", "two.joined").alias("joined"), "letters", "pc", "outward", "web", "mail", "places", "blocks",
        F.col("a.core").alias("addr_core"), F.col("a.kinds").alias("addr_kinds"), F.col("a.grams").alias("addr_grams"),
        F.col("o.core").alias("obj_core"), F.col("o.kinds").alias("obj_kinds"), F.col("o.grams").alias("obj_grams"),
        variants.grams_of("head").alias("name_grams"),
    ), "charities")

    # Each text of a charity is a set of its own; its id keeps the charity's in the upper part.  Associations that tell no
    # place are compared with the names of all places, but must share their rarest grams.
    somewhere = F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(F.array(F.lit("")))
    texts = F.array(*[F.struct((F.col("id") * 4 + i).alias("id"), F.col(g).alias("grams")) for i, g in enumerate(("name_grams", "addr_grams", "obj_grams"))])
    left = ch.select(somewhere.alias("blocks"), F.inline(texts)).where(F.size("grams") > 0)
    right = known.where(F.size("grams") > 0).select("id", F.concat("blocks", F.array(F.lit(""))).alias("blocks"), "grams")
    by_name = variants.similar_sets(left, right, 0.18, stricter={"": 0.4}).select(F.floor(F.col("l") / 4).cast("long").alias("l"), "r")

    now = staged(
        open_schools(spark, sf_dir).select("urn", "pc", "outward", host(F.col("website")).alias("site")).distinct(), "schools"
    )
    sites, codes = now.where("site is not null").select("urn", "site").distinct(), now.where("pc is not null").select("urn", "pc").distinct()
    mails = ch.select("id", F.explode(F.array_compact(F.array("web", "mail"))).alias("site")).distinct()
    join = variants.large_join
    direct = join(ch.select("id", "pc"), codes, "pc").select("id", "urn").unionByName(join(mails, sites, "site").select("id", "urn")).distinct()
    by_key = join(direct, known.select(F.col("id").alias("r"), F.col("target").alias("urn")), "urn").select(F.col("id").alias("l"), "r")
    pairs = staged(by_name.unionByName(by_key).distinct(), "pairs")

    a = ch.select(F.col("id").alias("l"), "core", "kinds", "letters", "addr_core", "addr_kinds", "obj_core", "obj_kinds")
    b = join(known, weights, "id", "left").select(
        F.col("id").alias("r"), F.col("core").alias("b_core"), F.col("kinds").alias("b_kinds"), F.col("phase").alias("b_phase"), F.col("name").alias("b_name"),
        F.coalesce("weights", F.expr("cast(array() as array<double>)")).alias("weights"), variants.place_words("place").alias("place"),
    )
    scored = linkage.compare(join(join(pairs, a, "l"), b, "r"))
    scored = join(scored, known.select(F.col("id").alias("r"), F.col("target").alias("urn"), F.col("kinds").alias("has")), "r")
    part = lambda s, k: F.coalesce(F.col(s) + 0.12 * F.col(k), F.lit(0.0))
    total = F.greatest(part("name_score", "name_kind"), part("addr_score", "addr_kind"), part("obj_score", "obj_kind"))
    best = staged(scored.withColumn("total", total).groupBy("l", "urn").agg(
        *[F.max_by(F.struct(f"{t}_score", f"{t}_kind"), part(f"{t}_score", f"{t}_kind")).alias(t) for t in ("name", "addr", "obj")],
        F.max("initials").alias("initials"), F.max("total").alias("score"), F.max_by("has", "total").alias("has"),
    ), "best")
    # What a charity or a school has by itself is found before the pairs, which are more and are shuffled once for each side.
    here = now.groupBy("urn").agg(F.collect_set("pc").alias("pcs"), F.collect_set("outward").alias("outs"), F.collect_set("site").alias("sites"))
    lies = known.groupBy(F.col("target").alias("urn")).agg(F.first(fold(F.col("place"))).alias("town"), F.first("la_name").alias("la_name"))
    side = ch.select(F.col("id").alias("l"), "plural", "joined", "letters", "pc", "outward", "web", "mail", "places")
    # A host is a school's if some school has it; others say nothing.
    own = sites.select("site").distinct()
    side = join(side, own.select(F.col("site").alias("web"), F.lit(True).alias("web_known")), "web", "left")
    side = join(side, own.select(F.col("site").alias("mail"), F.lit(True).alias("mail_known")), "mail", "left")
    facts = join(join(best, join(here, lies, "urn"), "urn"), side, "l")
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    text = lambda t: vote((F.col(f"{t}.{t}_score") >= 0.72) & (F.col(f"{t}.{t}_kind") > -0.5), (F.col(f"{t}.{t}_score") < 0.45) | (F.col(f"{t}.{t}_kind") <= -0.8))
    top = F.max("score").over(Window.partitionBy("l"))
    place = F.array_contains("places", F.col("town")) | F.array_contains("places", F.col("la_name"))
    voted = facts.select(
        F.col("l").alias("charity_number"), "urn", "score", "plural", "joined", "has",
        F.when(F.col("letters") != "", F.when(F.col("initials"), 1).otherwise(-1)).otherwise(text("name")).alias("v_name"),
        vote(F.greatest("name.name_kind", "obj.obj_kind") >= 0.5, F.least("name.name_kind", "obj.obj_kind") <= -0.5).alias("v_kind"),
        text("addr").alias("v_addr"), text("obj").alias("v_obj"),
        vote(F.array_contains("pcs", F.col("pc")), ~F.array_contains("outs", F.col("outward"))).alias("v_pc"),
        vote(F.array_contains("sites", F.col("web")), F.col("web_known")).alias("v_web"),
        vote(F.array_contains("sites", F.col("mail")), F.col("mail_known")).alias("v_mail"),
        vote(place, F.exists("places", lambda p: p == F.col("town")).isNotNull() & ~place & (F.size("places") >= 3)).alias("v_place"),
        vote(F.col("score") >= top - 0.02, F.col("score") < top - 0.1).alias("v_best"),
    )
    return linkage.confidence(staged(voted, "voted"), VOTES)  # it reads them twice


@C.query("p2_links")
def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between associations and schools with their confidence."""
    pairs = staged(association_links(spark, sf_dir), "links")
    # The best school of each association; an association of schools may have a second one, as good but for its kind.
    evidence = sum((F.col(v) for v in VOTES), F.lit(0))
    w = Window.partitionBy("charity_number").orderBy(F.col("confidence").desc(), F.col("score").desc(), evidence.desc(), "urn")
    ranked = pairs.withColumn("place", F.row_number().over(w)).withColumn("top", F.first("score").over(w)).withColumn("had", F.first("has").over(w))
    # A name that says otherwise must be outweighed by another text or address of the association, not by its place alone.
    backed = (F.col("v_name") >= 0) | (F.greatest("v_addr", "v_obj", "v_web", "v_mail") == 1)
    first = (F.col("place") == 1) & (F.col("confidence") >= 0.5)
    named = (F.col("v_name") >= 0) & (F.greatest("v_name", "v_obj") == 1)
    alike = (F.col("confidence") >= 0.5) | (named & (F.col("v_pc") >= 0) & (F.col("v_place") >= 0))
    # Kinds that the association joins mean two schools where the second is of a kind that the first is not.
    other = F.size(F.array_except(F.array_intersect("joined", "has"), "had")) > 0
    second = (F.col("place") == 2) & (F.col("plural") | other) & alike & (F.col("score") >= F.col("top") - 0.4)
    return ranked.where(backed & (first | second)).select("urn", "charity_number", "confidence")


@C.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parents' association with the school it belongs to, as that school is open now."""
    return p2_links(spark, sf_dir).select("urn", "charity_number")


# --- subjects ---------------------------------------------------------------------------------------------------------

#: Labelled documents that a model is fitted to at most; where there are more, a hash of their ids chooses.
LABELLED = 3000


def subject_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, subjects, probability) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", mixing.source_key(F.col("source")).alias("source"))
    areas = sorted(r.subject for r in table(spark, sf_dir, "subject_area").select("subject").distinct().collect() if r.subject)
    model = subjects.fit_from(docs, table(spark, sf_dir, "subject_label"), areas, bound=LABELLED)
    return subjects.label(docs, model)


@C.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document that has no label given by hand."""
    given = table(spark, sf_dir, "subject_label").select("doc_id").distinct()
    rows = subject_lists(spark, sf_dir).join(given, "doc_id", "left_anti")
    return rows.select("doc_id", F.explode("subjects").alias("subject")).distinct()


@C.query("p9_composition")
def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents and characters by subject; a document of several subjects counts in part."""
    rows = subject_lists(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    some = F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit("none")))
    part = rows.select(F.explode(some).alias("subject"), (1 / F.greatest(F.size("subjects"), F.lit(1))).alias("part"), "n")
    return part.groupBy("subject").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("part").alias("share_of_documents"), F.sum(F.col("part") * F.coalesce("n", F.lit(0))).alias("characters")
    )
