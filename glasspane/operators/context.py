"""Texts for and from a language model. The model itself is not called here."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..rules import answers as A
from ..rules import scoring as S

ANSWER = ("struct<tldr:string,plain_summary:string,headline_risks:array<string>,red_flags:array<struct<issue:string,"
          "evidence:string,severity:string,action:string>>,positive_findings:array<string>,compliance_gaps:"
          "array<struct<regulation:string,gap:string,recommendation:string>>,user_rights_summary:string,"
          "recommended_actions:array<string>,risk_narrative:string,data_story:string,ai_score_commentary:string>")
LISTS = {"headline_risks": "array<string>", "red_flags": "array<struct<issue:string,evidence:string,severity:string,action:string>>",
         "positive_findings": "array<string>", "compliance_gaps": "array<struct<regulation:string,gap:string,recommendation:string>>",
         "recommended_actions": "array<string>"}
EXCERPT_CHARS = 3500


def _names(items: str, n: int, empty: str, sep: str = ", ", field: str = "name") -> str:
    some = f"coalesce(array_join(transform(slice({items}, 1, {n}), x -> x.{field}), '{sep}'), '')"
    return T.let(some, lambda s: f"if({s} = '', {T.quote(empty)}, {s})")


def _flag(test: str, yes: str, no: str) -> str:
    return f"if(coalesce({test}, false), '{yes}', '{no}')"


def _by_sensitivity() -> str:
    from .data_types import by_sensitivity
    return by_sensitivity("data_types")


def summary(scored: DataFrame) -> DataFrame:
    """Adds `context`: twelve lines that sum a site up."""
    t = "tracking"
    lines = (
        "concat('Domain: ', domain)",
        "concat('Privacy Score: ', overall, '/100 (Grade: ', grade, ', Risk: ', risk_level, ')')",
        f"concat('Data Collected: ', {_names(_by_sensitivity(), 12, 'Unknown')})",
        f"concat('Third Parties: ', sharing.count, ' detected | Data Sold: ', "
        f"{_flag('sharing.data_sold', 'YES', 'No/Not stated')})",
        f"concat('Active Trackers: ', {_names(t + '.trackers', 10, 'None')})",
        f"concat('Browser Fingerprinting: ', {_flag(t + '.fingerprinting_detected', 'DETECTED', 'Not detected')})",
        f"concat('Session Recording: ', {_flag(t + '.session_recording_detected', 'ACTIVE', 'Not detected')})",
        f"concat('Dark Patterns: ', {_names('dark_patterns.detected', 5, 'None detected')})",
        "concat('GDPR Rights Coverage: ', rights.gdpr_score, '% | CCPA Coverage: ', rights.ccpa_score, '%')",
        "concat('Retention Policy: ', retention.overall_rating, ' | Vagueness Score: ', wording.vagueness_score, "
        "'/100 | Transparency: ', wording.transparency_score, '/100')",
        f"concat('Score Penalties: ', {_names('penalties', 5, 'None', '; ', 'reason')})",
        f"concat('Score Bonuses: ', {_names('bonuses', 3, 'None', '; ', 'reason')})")
    return scored.withColumn("context", F.expr(f"array_join(array({', '.join(lines)}), '\\n')"))


def excerpt(text: str) -> str:
    """The part of a policy that goes with the summary (the cut is the feature)."""
    return f"if(coalesce({text}, '') = '', 'No policy text available', substring({text}, 1, {EXCERPT_CHARS}))"


def chat(scored: DataFrame) -> DataFrame:
    """Adds `context`: what a chat about a site starts from."""
    t = "tracking"
    covered = "transform(filter(rights.gdpr, r -> r.covered), r -> named_struct('name', r.right_id))"
    missing = "transform(filter(rights.gdpr, r -> NOT r.covered), r -> named_struct('name', r.right_id))"
    lines = (
        "concat('PRIVACY ANALYSIS FOR ', domain)",
        "concat('Overall Score: ', overall, '/100 (Grade: ', grade, ', Risk Level: ', risk_level, ')')", "''",
        "'DATA COLLECTION:'", f"concat('Types Collected: ', {_names(_by_sensitivity(), 15, 'Unknown')})",
        f"concat('Data Sold to Third Parties: ', {_flag('sharing.data_sold', 'YES', 'No/Not stated')})", "''",
        "'TRACKING:'", f"concat('Active Trackers: ', {_names(t + '.trackers', 10, 'None detected')})",
        f"concat('Browser Fingerprinting: ', {_flag(t + '.fingerprinting_detected', 'DETECTED', 'Not detected')})",
        f"concat('Session Recording: ', {_flag(t + '.session_recording_detected', 'ACTIVE', 'Not detected')})",
        f"concat('Cookies Seen: ', {_names(t + '.cookies', 5, 'None detected')})", "''", "'THIRD PARTIES:'",
        f"concat('Named Partners: ', {_names('sharing.parties', 10, 'None named')})", "''", "'PRIVACY CONCERNS:'",
        f"concat('Dark Patterns: ', {_names('dark_patterns.detected', 5, 'None detected')})", "''", "'USER RIGHTS:'",
        f"concat('GDPR Rights Covered: ', {_names(covered, 99, 'None covered')})",
        f"concat('GDPR Rights Missing: ', {_names(missing, 99, 'All covered')})")
    return scored.withColumn("context", F.expr(f"array_join(array({', '.join(lines)}), '\\n')"))


def json_object(response: str, kind: str) -> str:
    """A stored model answer read as a JSON object, code fences dropped; null where it is none.

    A permissive reader fills a cut-off document with what it found, so only a whole one counts.
    """
    fences, ends = T.quote("```(?:json)?"), T.quote(r"^\s+|\s+$")
    clean = f"regexp_replace(regexp_replace({response}, {fences}, ''), {ends}, '')"
    return f"if(startswith({clean}, '{{') AND endswith({clean}, '}}'), from_json({clean}, '{kind}', map('mode', 'PERMISSIVE')), NULL)"


def parse_answers(answers: DataFrame) -> DataFrame:
    """Adds `answer` and `ai_available`: stored model answers read as JSON, code fences dropped."""
    return answers.withColumn("answer", F.expr(json_object("response", ANSWER))).withColumn("ai_available", F.col("answer").isNotNull())


def analyses(answers: DataFrame, sites: DataFrame) -> DataFrame:
    """One analysis for each stored answer (site_id, response and other columns): its fields, empty where the answer lacks them.

    An answer that cannot be read, or none at all, gives the fallback row made of the site's domain, grade and score (sites: site_id, domain, grade,
    overall), with ai_available = false; its texts are null where the site is unknown. Sites meet answers by id, so only names and scores are moved.
    """
    read = F.col("ai_available")
    known = sites.select("site_id", *[F.col(c).alias(f"site_{c}") for c in ("domain", "grade", "overall")])
    rows = parse_answers(answers).join(known, "site_id", "left")
    own = F.struct(*[F.col(f"site_{c}") for c in ("domain", "grade", "overall")]).alias("site")

    def filled(text: str) -> Column:
        parts = re.split(r"(\{\w+\})", text)
        field = {"{domain}": "site_domain", "{grade}": "site_grade", "{score}": "site_overall"}
        return F.concat(*[F.col(field[x]).cast("string") if x in field else F.lit(x) for x in parts if x])

    texts = [F.when(read, F.coalesce(f"answer.{k}", F.lit(""))).otherwise(filled(v)).alias(k) for k, v in A.FALLBACK.items()]
    risks = F.array(*map(F.lit, A.FALLBACK_RISKS))
    lists = [F.when(~read & F.lit(k == "headline_risks"), risks if k == "headline_risks" else F.lit(None)).otherwise(
        F.coalesce(F.col(f"answer.{k}"), F.from_json(F.lit("[]"), kind))).alias(k) for k, kind in LISTS.items()]
    return rows.select(*answers.columns, own, "ai_available", *texts, *lists)


def red_flags(parsed: DataFrame) -> DataFrame:
    """Red flags of the answers, most severe first."""
    rank = T.lookup({"critical": 0, "high": 1, "medium": 2, "low": 3}, "f.severity", 3)
    found = parsed.where("ai_available").select("conv_id", "turn", F.posexplode("answer.red_flags").alias("pos", "f"))
    return found.select("conv_id", "turn", "pos", "f.issue", "f.severity", F.expr(rank).alias("rank")).orderBy(
        "rank", "conv_id", "turn", "pos")


CRAWL = {"url": "string", "policy_url": "string", "policy_word_count": "int", "policy_discovery_method": "string"}


def label_json(scored: DataFrame, crawl: DataFrame | None = None) -> DataFrame:
    """One JSON document per site; every part is named, one that is missing is null.

    crawl: doc_id, url, policy_url, policy_word_count, policy_discovery_method, one row per site; sites without a row have nulls there.
    """
    fetched = list(CRAWL)
    if crawl is None:
        scored = scored.withColumn("crawl", F.struct(*[F.lit(None).cast(t).alias(c) for c, t in CRAWL.items()]))
    else:
        scored = scored.join(crawl.select("doc_id", F.struct(*[F.col(c).cast(t).alias(c) for c, t in CRAWL.items()]).alias("crawl")), "doc_id", "left")
    weights = F.struct(*[F.lit(w).alias(d) for d, w in S.WEIGHTS]).alias("weights")
    body = F.struct(
        F.col("crawl.url").alias("url"), "domain", "policy_found", *[F.col(f"crawl.{c}").alias(c) for c in fetched[1:]],
        F.col("overall").alias("overall_score"), "grade", "risk_level", "summary",
        F.struct(*[F.col(f"{d}_score").alias(d) for d, _ in S.WEIGHTS], weights).alias("score_breakdown"), "penalties", "bonuses",
        *[F.when(F.col("state") == "full", F.col(c)).alias(c) for c in ("data_types", "retention", "wording",
                                                                        "dark_patterns", "rights", "sharing")],
        F.col("tracking").alias("trackers"))
    return scored.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("result_json"))
