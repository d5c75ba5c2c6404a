"""Scalar expressions and predicates that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Match status codes, queue ids by family and their labels, rank tiers
#: in their order and those of the group Emerald+, roles and grades.
UNFETCHED, SUCCESS, TEMPORARY_FAILURE, PERMANENT_FAILURE, OUTSIDE_RETENTION = 0, 1, 2, 3, 4
RANKED_SOLO, RANKED_FLEX = 420, 440
QUEUE_FAMILIES = {
    "RANKED_SOLO_DUO": [420],
    "RANKED_FLEX": [440],
    "ARAM": [450],
    "NORMAL_SR": [400, 430, 490],
    "CLASH": [700],
    "ARENA": [1700, 1710, 1810, 1820, 1830, 1840],
    "ROTATING": [76, 78, 83, 98, 100, 310, 313, 315, 317, 318, 325, 600, 610, 720, 900, 920, 940, 1020, 1300, 1400, 1900],
    "BOT": [820, 830, 840, 850],
    "CUSTOM": [0],
}
QUEUE_LABELS = {420: "Ranked Solo/Duo", 440: "Ranked Flex", 400: "Normal Draft", 430: "Normal Blind", 490: "Quickplay", 450: "ARAM", 700: "Clash", 1700: "Arena"}
EMERALD_PLUS = ["EMERALD", "DIAMOND", "MASTER", "GRANDMASTER", "CHALLENGER"]
TIERS = ["IRON", "BRONZE", "SILVER", "GOLD", "PLATINUM", "EMERALD", "DIAMOND", "MASTER", "GRANDMASTER", "CHALLENGER"]
ROLES = ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"]
GRADES = ["S", "A", "B", "C", "D"]


def ranked_solo() -> Column:
    """Ranked solo games, also those stored with the queue as text."""
    return (F.col("queue_id") == RANKED_SOLO) | ((F.col("queue_id") == 0) & (F.col("queue_type") == str(RANKED_SOLO)))


def visible() -> Column:
    return F.col("status") != PERMANENT_FAILURE


def tier_scope(scope: str | None) -> list[str] | None:
    """Tiers that a rank scope names, None for all."""
    s = (scope or "").strip().upper().replace("+", "_PLUS")
    if s in ("", "ALL"):
        return None
    return EMERALD_PLUS if s == "EMERALD_PLUS" else [s]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def effective_minimum(configured: int | Column, available: Column, floor: int) -> Column:
    """Games that a group needs: 15 % of what there is, between the floor and
    the configured number, and never more than there is."""
    conf = configured if isinstance(configured, Column) else F.lit(configured)
    share = F.greatest(F.lit(floor), F.ceil(F.lit(0.15) * available))
    return F.greatest(F.lit(1), F.least(conf, F.least(available, share)))


def adaptive_minimum(released_ms: Column, now_ms: int, steady: int = 100, early: int = 40, hours: int = 72) -> Column:
    """The configured minimum, lower in a patch's first hours; a patch whose
    release isn't known is past them."""
    steady = max(1, steady)
    if hours <= 0:
        return F.lit(steady)
    return F.when(F.lit(now_ms) < released_ms + hours * 3_600_000, min(max(1, early), steady)).otherwise(steady)


def patch_order(patch: Column) -> Column:
    """A value by which patches sort as numbers: 9.2 before 14.1."""
    part = lambda i: F.coalesce(F.split_part(patch, F.lit("."), F.lit(i)).try_cast("int"), F.lit(-1))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), patch.alias("text"))


def wilson(wins: Column, games: Column, z: float = 1.96) -> Column:
    """Lower bound of the win rate; 0 without games."""
    p = wins / games
    z2 = z * z
    bound = (p + z2 / (2 * games) - z * F.sqrt((p * (1 - p) + z2 / (4 * games)) / games)) / (1 + z2 / games)
    return F.when(games <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), bound))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def cs_per_minute() -> Column:
    return F.when(F.col("duration") > 0, (F.col("minions") + F.col("neutral")) / (F.col("duration") / 60)).otherwise(0.0)


def kda(kills: Column, assists: Column, deaths: Column) -> Column:
    return (kills + assists) / F.greatest(F.lit(1), deaths)


def queue_family(queue_id: Column) -> Column:
    out = None
    for family, ids in QUEUE_FAMILIES.items():
        out = (F if out is None else out).when(queue_id.isin(ids), family)
    return out.otherwise("OTHER")


def queue_label(queue_id: Column) -> Column:
    out = None
    for i, label in QUEUE_LABELS.items():
        out = (F if out is None else out).when(queue_id == i, label)
    return out.otherwise(queue_id.cast("string"))


def in_history_scope(queue_id: Column) -> Column:
    return ~queue_id.isin(QUEUE_FAMILIES["CUSTOM"] + QUEUE_FAMILIES["BOT"])


def tier_score(tier: Column) -> Column:
    """1 for the lowest tier to 10 for the highest, 3 if it isn't known."""
    out = None
    for i, name in enumerate(TIERS, 1):
        out = (F if out is None else out).when(F.upper(tier) == name, float(i))
    return out.otherwise(3.0)


def grade_of(percentile: Column) -> Column:
    return F.when(percentile < 0.10, "S").when(percentile < 0.30, "A").when(percentile < 0.60, "B").when(percentile < 0.85, "C").otherwise("D")


def grade_value(grade: Column) -> Column:
    """5 for S to 1 for D."""
    out = None
    for i, g in enumerate(GRADES):
        out = (F if out is None else out).when(grade == g, 5 - i)
    return out


def grade_of_rate(win_rate: Column) -> Column:
    return F.when(win_rate >= 0.53, "S").when(win_rate >= 0.51, "A").when(win_rate >= 0.49, "B").when(win_rate >= 0.47, "C").otherwise("D")


def matchup_verdict(win_rate: Column) -> Column:
    return F.when(win_rate >= 0.52, "favorable").when(win_rate <= 0.48, "unfavorable").otherwise("even")


def match_platform(match_id: Column) -> Column:
    """Platform code in front of a match id."""
    return F.upper(F.split_part(match_id, F.lit("_"), F.lit(1)))


def role_alias(role: Column) -> Column:
    r = F.upper(F.trim(role))
    return F.when(r.isNull() | r.isin("", "NONE"), "UNKNOWN").when(r == "SUPPORT", "UTILITY").otherwise(r)


def age_bucket(then_ms: Column, now_ms: int) -> Column:
    minutes = F.floor((F.lit(now_ms) - then_ms) / 60_000)
    return (
        F.when(minutes < 1, "Just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" hours ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" days ago")))
    )
