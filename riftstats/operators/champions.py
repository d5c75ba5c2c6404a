"""Champion analytics over all patches and champions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import EMERALD_PLUS, GRADES, ROLES, SUCCESS, adaptive_minimum, effective_minimum, grade_of, grade_of_rate, grade_value, matchup_verdict, patch_order, rate, tier_scope, wilson
from ..sources.versioned import VersionedTable
from .scope import in_region, in_tiers, marked_tiers, ranked_rows, shared, solo_ranks, visible_matches

#: Item classes that aren't completed builds, and items that are
#: left out where the patch's metadata is incomplete.
EXCLUDED_TAGS = ["consumable", "trinket", "vision"]
EXCLUDED_ITEMS = [3340, 3363, 3364, 2055, 2003, 2010, 2031, 2033, 2138, 2139, 2140, 1001, 1004, 1011, 1018, 1026, 1027, 1028, 1029, 1031, 1033, 1035, 1036, 1037, 1038, 1042, 1043, 1052, 1053, 1054, 1055, 1056, 1057, 1058, 1082, 1083, 2420, 2421, 2422, 3024, 3052, 3070]
CORE_SHARE, COVERAGE = 0.70, 0.90
#: Digits that a score has before it is ranked, so that equal scores tie.
SCORE_DIGITS = 12


@dataclass(frozen=True)
class Sample:
    """Games that a group needs: `steady`, but `early` in the first `hours` of a
    patch if the patches' releases (patch, released_at) and the time are given."""

    steady: int = 100
    early: int = 40
    hours: int = 72
    patches: DataFrame | None = None
    now_ms: int | None = None

    def on(self, groups: DataFrame) -> DataFrame:
        """Groups (with their patch) and their minimum in `_minimum`."""
        if self.patches is None or self.now_ms is None:
            return groups.withColumn("_minimum", F.lit(max(1, self.steady)))
        released = self.patches.select("patch", F.col("released_at").alias("_released"))
        wanted = adaptive_minimum(F.col("_released"), self.now_ms, self.steady, self.early, self.hours)
        return groups.join(released, "patch", "left").withColumn("_minimum", wanted).drop("_released")


def sample_of(minimum: int | Sample) -> Sample:
    return minimum if isinstance(minimum, Sample) else Sample(minimum)


def keep_enough(groups: DataFrame, minimum: Column, *scope: str) -> DataFrame:
    """Groups with at least the minimum of games; all of a scope if none has."""
    enough = F.col("games") >= minimum
    return groups.withColumn("_enough", enough).withColumn("_any", F.max("_enough").over(Window.partitionBy(*scope))).where("_enough or not _any").drop("_enough", "_any")


def current_patch(patches: DataFrame, matches: DataFrame) -> DataFrame:
    """The active patch, else that of the latest fetched match."""
    active = patches.where("is_active").agg(F.max("patch").alias("active"))
    latest = visible_matches(matches).where((F.col("status") == SUCCESS) & F.col("patch").isNotNull()).agg(F.max_by("patch", F.struct("fetched_at", "match_id")).alias("latest"))
    return active.crossJoin(latest).select(F.coalesce("active", "latest").alias("patch"))


def role_ranks(matches: DataFrame, participants: DataFrame, ranks: DataFrame, summoners: DataFrame | None = None, region: str | None = None) -> DataFrame:
    """Place of a champion among those of its role and tier."""
    rows = in_region(ranked_rows(matches, participants), summoners, region).join(solo_ranks(ranks), "puuid")
    groups = rows.groupBy("patch", F.col("team_position").alias("role"), F.col("tier").alias("rank_tier"), "champion_id").agg(F.count("*").alias("games"), F.count_if("win").alias("wins"))
    scope = Window.partitionBy("patch", "role", "rank_tier")
    order = scope.orderBy((F.col("wins") / F.col("games")).desc(), F.desc("games"), "champion_id")
    return groups.withColumn("role_rank", F.row_number().over(order)).withColumn("role_population", F.count("*").over(scope))


def champion_winrates(matches: DataFrame, participants: DataFrame, bans: DataFrame, ranks: DataFrame, minimum: int | Sample = 100, scope: str | None = None, summoners: DataFrame | None = None, region: str | None = None) -> DataFrame:
    """Win, pick and ban rates by champion, role and tier. The pick rate is the
    share of the champion's own rows; the ban rate looks at the group's matches.
    Rows are counted once a match first, so that matches need no distinct count; the
    place among the champions of a role and tier comes from the same groups."""
    rows = in_region(ranked_rows(matches, participants), summoners, region).join(solo_ranks(ranks), "puuid", "left").withColumn("rank_tier", F.coalesce("tier", F.lit("UNRANKED")))
    if tiers := tier_scope(scope):
        rows = rows.where(F.col("rank_tier").isin(tiers))
    banned = bans.select("match_id", "champion_id").distinct().withColumn("banned", F.lit(True))
    keys = ["patch", "champion_id", "role", "rank_tier"]
    rows = rows.join(banned, ["match_id", "champion_id"], "left").withColumn("role", F.col("team_position"))
    once = rows.groupBy("match_id", *keys).agg(F.count("*").alias("n"), F.count_if("win").alias("won"), F.bool_or("banned").alias("banned"))
    groups = once.groupBy(*keys).agg(F.sum("n").alias("games"), F.sum("won").alias("wins"), F.count("*").alias("group_matches"), F.count_if("banned").alias("banned_matches"))
    peers = Window.partitionBy("patch", "role", "rank_tier")
    order = peers.orderBy((F.col("wins") / F.col("games")).desc(), F.desc("games"), "champion_id")
    ranked = F.col("rank_tier") != "UNRANKED"
    groups = groups.withColumn("role_rank", F.when(ranked, F.row_number().over(order))).withColumn("role_population", F.when(ranked, F.count("*").over(peers)))
    groups = groups.withColumn("total", F.sum("games").over(Window.partitionBy("patch", "champion_id")))
    kept = keep_enough(sample_of(minimum).on(groups), effective_minimum(F.col("_minimum"), F.col("total"), 3), "patch", "champion_id")
    return kept.select(
        *keys, "games", "wins", rate(F.col("wins"), F.col("games")).alias("win_rate"), rate(F.col("games"), F.col("total")).alias("pick_rate"),
        rate(F.col("banned_matches"), F.col("group_matches")).alias("ban_rate"), "role_rank", "role_population",
    )


def tier_counts(rows: DataFrame, bans: DataFrame) -> DataFrame:
    """Games, wins and bans of champions within each patch and scope; a null
    champion counts the scope's matches in `banned`. rows: patch, match_id,
    champion_id, win, scopes (array of structs, those that the row counts in).
    One pass: the rows of a match meet once with its bans. Counts of disjoint sets
    of matches add up."""
    entry = lambda scopes, champions, win: F.struct(scopes.alias("scopes"), champions.cast("array<int>").alias("champions"), win.cast("boolean").alias("win"))
    play = entry(F.col("scopes"), F.array("champion_id"), F.coalesce("win", F.lit(False)))
    plays = rows.groupBy("patch", "match_id").agg(F.collect_list(play).alias("played"))
    lost = bans.groupBy("match_id").agg(F.collect_set("champion_id").alias("banned"))
    banned = F.array_append(F.coalesce("banned", F.array().cast("array<int>")), F.lit(None).cast("int"))
    # the match is an entry beside its plays: every scope that it has was without its banned champions; entries are
    # unfolded row by row, as functions over nested arrays take several times as long
    match = entry(F.array_distinct(F.flatten("played.scopes")), banned, F.lit(None))
    entries = plays.join(lost, "match_id", "left").select("patch", F.explode(F.concat("played", F.array(match))).alias("e"))
    entries = entries.select("patch", F.explode("e.scopes").alias("s"), F.col("e.champions").alias("champions"), F.col("e.win").alias("win")).select("patch", "s", F.explode("champions").alias("champion_id"), "win")
    counts = entries.groupBy("patch", "s", "champion_id").agg(F.count("win").alias("games"), F.count_if("win").alias("wins"), F.count_if(F.col("win").isNull()).alias("banned"))
    return counts.select("patch", "s.*", "champion_id", "games", "wins", "banned")


#: The columns of tier_counts that add up.
TIER_SUMS = ("games", "wins", "banned")


def added_counts(counts: DataFrame) -> DataFrame:
    """Counts of several sets of matches as those of all of them."""
    keys = [c for c in counts.columns if c not in TIER_SUMS]
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in TIER_SUMS])


def scores_of(counts: DataFrame, minimum: int | Sample, floor: int = 5) -> DataFrame:
    """Scores and grades of champions within each patch and scope, from counts."""
    keys = [c for c in counts.columns if c not in (*TIER_SUMS, "champion_id")]
    whole = Window.partitionBy(*keys)
    groups = counts.withColumn("n_matches", F.max(F.when(F.col("champion_id").isNull(), F.col("banned"))).over(whole)).withColumn("participants", F.sum("games").over(whole)).where("games > 0")
    kept = keep_enough(sample_of(minimum).on(groups), effective_minimum(F.col("_minimum"), F.col("participants"), floor), *keys)
    share = rate(F.col("games"), F.col("participants"))
    scored = kept.select(
        *keys, "champion_id", "games", rate(F.col("wins"), F.col("games")).alias("win_rate"), share.alias("pick_rate"), rate(F.col("banned"), F.col("n_matches")).alias("ban_rate"),
        F.round(wilson(F.col("wins"), F.col("games")) * 0.70 + share * 0.30, SCORE_DIGITS).alias("score"),
    )
    order = whole.orderBy(F.desc("score"), "champion_id")
    place = (F.row_number().over(order) - 1) / F.count("*").over(whole)
    return scored.withColumn("place", F.row_number().over(order)).withColumn("grade", grade_of(place))


def tier_scores(rows: DataFrame, bans: DataFrame, minimum: int | Sample, floor: int = 5) -> DataFrame:
    return scores_of(tier_counts(rows, bans), minimum, floor)


def tier_list(matches: DataFrame, participants: DataFrame, bans: DataFrame, ranks: DataFrame | None = None, role: str = "ALL", scope: str | None = None, minimum: int | Sample = 100) -> DataFrame:
    """Graded champions of every patch, for one role or all together."""
    rows = in_tiers(ranked_rows(matches, participants, role=role), ranks, scope)
    return tier_scores(rows.select("patch", "match_id", "champion_id", "win", F.array(F.struct(F.lit(role.upper()).alias("role"))).alias("scopes")), bans, minimum)


def tier_lists_by_role(matches: DataFrame, participants: DataFrame, bans: DataFrame, ranks: DataFrame | None = None, scope: str | None = None, minimum: int | Sample = 100) -> DataFrame:
    """The tier lists of the five roles in one pass."""
    rows = in_tiers(ranked_rows(matches, participants), ranks, scope).where(F.col("team_position").isin(ROLES))
    return tier_scores(rows.select("patch", "match_id", "champion_id", "win", F.array(F.struct(F.col("team_position").alias("role"))).alias("scopes")), bans, minimum)


def previous_patches(patches: DataFrame) -> DataFrame:
    """(patch, previous) among the ten newest."""
    newest = patches.orderBy(F.desc("released_at"), F.desc("patch")).limit(10)
    return newest.select("patch", F.lead("patch").over(Window.orderBy(F.desc("released_at"), F.desc("patch"))).alias("previous"))


def tier_movement(tiers: DataFrame, patches: DataFrame, compat: bool = False) -> DataFrame:
    """Grade against the previous patch: NEW, UP, DOWN or SAME. compat treats a
    champion that wasn't there before as S."""
    before = tiers.select(F.col("patch").alias("previous"), "role", "champion_id", F.col("grade").alias("previous_grade"))
    joined = tiers.join(F.broadcast(previous_patches(patches)), "patch", "left").join(before, ["previous", "role", "champion_id"], "left")
    was = F.coalesce("previous_grade", F.lit("S")) if compat else F.col("previous_grade")
    now, then = grade_value(F.col("grade")), grade_value(was)
    movement = F.when(was.isNull(), "NEW").when(now > then, "UP").when(now < then, "DOWN").otherwise("SAME")
    return joined.select(*tiers.columns, was.alias("previous_grade"), movement.alias("movement"))


def item_flags(versions: DataFrame) -> DataFrame:
    """(patch, flags): for each patch the map of its known items to whether they
    are completed builds. A patch has some hundreds of items."""
    is_built = F.col("in_store") & (F.col("price_total") > 0) & (F.size("builds_into") == 0) & (F.size("builds_from") > 0) & ~F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), F.array(*[F.lit(t) for t in EXCLUDED_TAGS]))
    once = versions.groupBy("patch", "item_id").agg(F.max(F.coalesce(is_built, F.lit(False))).alias("built"))
    return once.groupBy("patch").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "built"))).alias("flags"))


SCOPE = ["patch", "champion_id", "role"]


def build_groups(matches: DataFrame, participants: DataFrame, items: DataFrame, versions: DataFrame, pages: DataFrame | None = None, ranks: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Ranked games and wins by champion, role, the sorted list `items` of completed
    items and, with the participants' `pages`, their rune_key; games without a
    completed item are left out. Where the patch's metadata knows less than
    COVERAGE of the distinct items that a champion's games of a role hold, unknown
    items count unless they are on the exclusion list."""
    key, by = ["match_id", "participant_id"], [*SCOPE, "items"]
    rows = in_tiers(ranked_rows(matches, participants), ranks, scope).select("patch", "champion_id", F.col("team_position").alias("role"), *key, "win").join(item_lists(items), key)
    if pages is not None:
        rows, by = rows.join(pages.select(*key, "rune_key"), key, "left").withColumn("rune_key", F.coalesce("rune_key", F.lit("0:|0:|"))), [*by, "rune_key"]
    groups = shared(rows.groupBy(*by).agg(F.count("*").alias("games"), F.count_if("win").alias("wins"))).join(item_flags(versions), "patch", "left")
    is_known = lambda i: F.map_contains_key(F.coalesce("flags", F.create_map().cast("map<int,boolean>")), i)
    seen = groups.select(*SCOPE, F.explode(F.array_distinct("items")).alias("item_id"), "flags").groupBy(*SCOPE, "item_id").agg(F.max(is_known(F.col("item_id"))).alias("known"))
    cover = seen.groupBy(*SCOPE).agg((F.count_if("known") / F.count("*")).alias("cover"))
    keep = lambda i: F.when(is_known(i), F.try_element_at("flags", i)).otherwise((F.col("cover") < COVERAGE) & ~i.isin(EXCLUDED_ITEMS))
    kept = groups.join(cover, SCOPE).withColumn("items", F.filter("items", keep)).where(F.size("items") > 0)
    return kept.groupBy(*by).agg(F.sum("games").alias("games"), F.sum("wins").alias("wins"))


def frequencies(games: DataFrame, n: Column) -> DataFrame:
    """Of each scope's `n` games with the items of the array `items`, those that
    have an item. The scope's own total is counted in the same aggregation, as
    the games of a null item."""
    key = SCOPE
    marked = F.explode(F.array_append(F.array_distinct("items"), F.lit(None).cast("int")))
    counts = games.select(*key, n.alias("_n"), marked.alias("item_id")).groupBy(*key, "item_id").agg(F.sum("_n").alias("games"))
    eligible = F.max(F.when(F.col("item_id").isNull(), F.col("games"))).over(Window.partitionBy(*key))
    counts = counts.withColumn("eligible", eligible).where("item_id is not null")
    share = F.col("games") / F.col("eligible")
    return counts.select(*key, "item_id", "games", "eligible", share.alias("frequency"), (share >= CORE_SHARE).alias("is_core"))


def item_frequency(matches: DataFrame, participants: DataFrame, items: DataFrame, versions: DataFrame, ranks: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Share of a champion's games (with a completed item) that have an item."""
    return frequencies(build_groups(matches, participants, items, versions, None, ranks, scope), F.col("games"))


def rune_pages(runes: DataFrame, versions: DataFrame, policy: str = "builds") -> DataFrame:
    """One page a participant: styles, primary, secondary and shards, and a key.

    Rows with a tree or style of their own and unique places are taken as they
    are; others are inferred from the runes' paths. Policies: `builds` drops
    unknown runes and keeps all shards, `history` looks a rune up in the patch,
    then in any patch, counts unknown ones to path 0, keeps 3 shards and guards
    styles by path < 5000, `detail` is `history` without the guard."""
    key = ["match_id", "participant_id"]
    meta = versions.select("rune_id", "patch", "path_id", "slot")
    # a patch has about a hundred runes: these are sent out, so that selections stay where their match is
    rows = runes.join(F.broadcast(meta), ["rune_id", "patch"], "left")
    if policy != "builds":
        anywhere = versions.groupBy("rune_id").agg(F.max_by("path_id", patch_order(F.col("patch"))).alias("any_path"), F.max_by("slot", patch_order(F.col("patch"))).alias("any_slot"))
        rows = rows.join(F.broadcast(anywhere), "rune_id", "left").withColumn("path_id", F.coalesce("path_id", "any_path", F.lit(0))).withColumn("slot", F.coalesce("slot", "any_slot", F.lit(0)))
    # the few runes of a participant are counted within their array, which needs one shuffle only
    r = F.struct("tree", "idx", "rune_id", "style_id", "path_id", "slot")
    grouped = rows.groupBy(*key).agg(F.sort_array(F.collect_list(r)).alias("r"))
    return pages_of(grouped, policy, key, F.col("r"))


def carried_pages(rows: DataFrame, versions: DataFrame, policy: str = "builds") -> DataFrame:
    """Rows with the page that `rune_pages` gives, from an array `runes` of (tree,
    idx, rune_id, style_id) within the row (null or empty: no page) and the row's
    `patch`; nothing is dealt out or gathered. A rune has one version a patch."""
    once = versions.where("rune_id is not null").groupBy("patch", "rune_id").agg(F.max(F.struct("path_id", "slot")).alias("v"))
    as_map = F.map_from_entries(F.collect_list(F.struct("rune_id", "v")))
    key = [c for c in rows.columns if c != "runes"]
    # a patch has about a hundred runes, which are sent out as one map a patch
    rows = rows.join(F.broadcast(once.groupBy("patch").agg(as_map.alias("_patch"))), "patch", "left")
    of = lambda x, c: F.element_at("_patch", x["rune_id"])[c]
    if policy != "builds":
        newest = F.max_by("v", patch_order(F.col("patch"))).alias("v")
        rows = rows.crossJoin(F.broadcast(once.groupBy("rune_id").agg(newest).agg(as_map.alias("_any"))))
        of = lambda x, c: F.coalesce(F.element_at("_patch", x["rune_id"])[c], F.element_at("_any", x["rune_id"])[c], F.lit(0))
    placed = F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in ("tree", "idx", "rune_id", "style_id")], of(x, "path_id").alias("path_id"), of(x, "slot").alias("slot")))
    return pages_of(rows.withColumn("r", F.when(F.size("runes") > 0, F.sort_array("runes"))), policy, key, placed)


def pages_of(grouped: DataFrame, policy: str, key: list[str], placed: Column) -> DataFrame:
    """Columns `key` and the page of each row's selections `r`, sorted by tree and
    place; no page where that is null. `placed`, `r` with paths and slots, is looked
    at only where selections don't tell tree and style themselves."""
    own = F.exists("r", lambda x: (x["tree"] != 0) | (x["style_id"] != 0))
    places = F.array_compact(F.array_distinct(F.transform("r", lambda x: F.when(x["idx"].isNotNull(), x["tree"].cast("long") * 2**32 + x["idx"]))))
    of_tree = lambda t: F.filter("r", lambda x: x["tree"] == t)
    told = lambda t: F.get(F.filter("r", lambda x: (x["tree"] == t) & (x["style_id"] > 0)), 0)["style_id"]
    grouped = grouped.withColumn("_structured", F.coalesce(own & (F.size(places) == F.size("r")), F.lit(False))).withColumn("_told", F.when(F.col("_structured"), F.struct(told(0).alias("of0"), told(1).alias("of1"))))
    structured = F.col("_structured")
    grouped = grouped.withColumn("_v", F.when(~(structured & F.col("_told.of0").isNotNull() & F.col("_told.of1").isNotNull()), placed))

    pathed = lambda x: (x["path_id"] > 0) & (x["path_id"] < 5000)
    guard = pathed if policy != "detail" else lambda x: x["path_id"] > 0
    first = lambda t: F.get(F.filter("_v", lambda x: x["tree"] == t), 0)
    style = lambda t: F.coalesce(F.col(f"_told.of{t}"), F.when(guard(first(t)), first(t)["path_id"]), F.lit(0))
    known = F.array_distinct(F.filter("_v", pathed)["path_id"])
    paths = F.sort_array(F.transform(known, lambda p: F.struct((-F.size(F.filter("_v", lambda x: x["path_id"] == p))).alias("n"), p.alias("path"))))
    grouped = grouped.withColumn("_paths", F.when(~structured, paths))
    by_slot = lambda keep: F.sort_array(F.transform(F.filter("_v", keep), lambda x: F.struct(x["slot"].alias("slot"), x["rune_id"].alias("rune_id"))))["rune_id"]
    path = lambda i: F.coalesce(F.get("_paths", i)["path"], F.lit(0))
    on_path = lambda i: by_slot(lambda x: pathed(x) & (x["path_id"] == path(i)))
    shards = F.when(structured, of_tree(2)["rune_id"]).otherwise(by_slot(lambda x: x["path_id"] >= 5000))
    there = lambda c: F.when(F.col("r").isNotNull(), c)
    page = grouped.select(
        *key,
        there(F.when(structured, style(0)).otherwise(path(0))).alias("primary_style"), there(F.when(structured, style(1)).otherwise(path(1))).alias("sub_style"),
        there(F.when(structured, of_tree(0)["rune_id"]).otherwise(on_path(0))).alias("primary"), there(F.when(structured, of_tree(1)["rune_id"]).otherwise(on_path(1))).alias("sub"),
        there(shards if policy == "builds" else F.slice(shards, 1, 3)).alias("shards"),
    )
    text = lambda a: F.concat_ws(",", F.col(a).cast("array<string>"))
    return page.withColumn("rune_key", F.concat(F.col("primary_style").cast("string"), F.lit(":"), text("primary"), F.lit("|"), F.col("sub_style").cast("string"), F.lit(":"), text("sub"), F.lit("|"), text("shards")))


def champion_builds(matches: DataFrame, participants: DataFrame, items: DataFrame, versions: DataFrame, runes: DataFrame, rune_versions: DataFrame, ranks: DataFrame | None = None, scope: str | None = None, minimum: int | Sample = 100, base: int = 30) -> DataFrame:
    """Top three builds (completed items and runes) of a champion and role."""
    key = SCOPE
    all_groups = shared(build_groups(matches, participants, items, versions, rune_pages(runes, rune_versions), ranks, scope).withColumn("item_key", F.concat_ws(",", F.col("items").cast("array<string>"))))
    groups = sample_of(minimum).on(all_groups.withColumn("eligible", F.sum("games").over(Window.partitionBy(*key)))).where(F.col("eligible") >= effective_minimum(F.col("_minimum"), F.col("eligible"), 3)).drop("_minimum")
    kept = keep_enough(groups, effective_minimum(base, F.col("eligible"), 2), *key)
    order = Window.partitionBy(*key).orderBy(F.desc("wins"), F.desc("games"), "item_key", "rune_key")
    top = kept.withColumn("place", F.row_number().over(order)).where("place <= 3")
    core = frequencies(all_groups, F.col("games")).where("is_core").groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("core"))
    top = top.join(core, key, "left").withColumn("core", F.coalesce("core", F.array().cast("array<int>")))
    rest = F.array_distinct(F.filter("items", lambda x: ~F.array_contains(F.col("core"), x)))
    return top.select(*key, "place", "item_key", "rune_key", "games", "wins", rate(F.col("wins"), F.col("games")).alias("win_rate"), "core", rest.alias("situational"))


def lane_matchups(matches: DataFrame, participants: DataFrame, snapshots: DataFrame, ranks: DataFrame | None = None, scope: str | None = None, minimum: int = 30) -> DataFrame:
    """Champions against those of the same position in the other team, with the
    gold and experience difference at the snapshot where both are known. The ten
    players of a match are paired within its row; only the champion's side has to
    be in the rank scope."""
    rows = marked_tiers(ranked_rows(matches, participants), ranks, scope, "own")
    player = F.struct("participant_id", "team_position", "team_id", "champion_id", "win", "own")
    sides = rows.groupBy("patch", "match_id").agg(F.collect_list(player).alias("players"))
    snap = snapshots.groupBy("match_id").agg(F.collect_list(F.struct("participant_id", "gold", "xp", "derived_at")).alias("snaps"))
    at = lambda x: F.get(F.filter("snaps", lambda s: s["participant_id"] == x["participant_id"]), 0).alias("at")
    sides = sides.join(snap, "match_id", "left").withColumn("players", F.transform("players", lambda x: F.struct(x["team_position"].alias("role"), x["team_id"].alias("team_id"), x["champion_id"].alias("champion_id"), x["win"].alias("win"), x["own"].alias("own"), at(x))))
    facing = lambda a: F.filter("players", lambda b: (b["role"] == a["role"]) & (b["team_id"] != a["team_id"]))
    pairs = F.flatten(F.transform(F.filter("players", lambda x: x["own"]), lambda a: F.transform(facing(a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = sides.select("patch", F.explode(pairs).alias("p")).select("patch", F.col("p.a.champion_id").alias("champion_id"), F.col("p.a.role").alias("role"), F.col("p.b.champion_id").alias("opponent_id"), F.col("p.a.win").alias("win"), F.col("p.a.at").alias("x"), F.col("p.b.at").alias("y"))
    both = F.col("x.gold").isNotNull() & F.col("y.gold").isNotNull()
    groups = pairs.groupBy("patch", "champion_id", "role", "opponent_id").agg(
        F.count("*").alias("games"), F.count_if("win").alias("wins"), F.count_if(both).alias("timeline_games"), F.avg(F.when(both, F.col("x.gold") - F.col("y.gold"))).alias("gold_diff"),
        F.avg(F.when(both, F.col("x.xp") - F.col("y.xp"))).alias("xp_diff"), F.max("x.derived_at").alias("derived_at"),
    )
    total = F.sum("games").over(Window.partitionBy("patch", "champion_id", "role"))
    groups = groups.withColumn("_total", total)
    kept = keep_enough(groups, effective_minimum(minimum, F.col("_total"), 2), "patch", "champion_id", "role")
    return kept.select("patch", "champion_id", "role", "opponent_id", "games", "wins", (F.col("games") - F.col("wins")).alias("losses"), rate(F.col("wins"), F.col("games")).alias("win_rate"), "timeline_games", "gold_diff", "xp_diff", "derived_at")


def matchup_verdicts(matchups: DataFrame) -> DataFrame:
    """Matchups with the label of their win rate, as a page shows them."""
    return matchups.select("patch", "champion_id", "role", "opponent_id", "games", "win_rate", matchup_verdict(F.col("win_rate")).alias("verdict"))


def counters_and_favorable(matchups: DataFrame, n: int = 5) -> DataFrame:
    """The n worst matchups below 48 % and the n best above 52 %."""
    own = Window.partitionBy("patch", "champion_id", "role")
    bad = matchups.where("win_rate < 0.48").withColumn("place", F.row_number().over(own.orderBy("win_rate", F.desc("games"), "opponent_id"))).withColumn("side", F.lit("counter"))
    good = matchups.where("win_rate > 0.52").withColumn("place", F.row_number().over(own.orderBy(F.desc("win_rate"), F.desc("games"), "opponent_id"))).withColumn("side", F.lit("favorable"))
    return bad.unionByName(good).where(F.col("place") <= n).select("patch", "champion_id", "role", "side", "place", "opponent_id", "games", "win_rate")


def timeline_quality(matchups: DataFrame) -> DataFrame:
    got = matchups.groupBy("patch", "champion_id", "role").agg(F.sum("games").alias("games"), F.sum("timeline_games").alias("sample_size"), F.max("derived_at").alias("derived_at"))
    return got.withColumn("coverage", F.when(F.col("games") > 0, F.col("sample_size") / F.col("games")))


def popular_champions(matches: DataFrame, participants: DataFrame, n: int = 100, per_role: int = 12) -> DataFrame:
    """Most played (champion, role) of each patch, then the first of each role."""
    rows = participants.where("team_position is not null").join(matches.where(F.col("status") == SUCCESS).select("match_id", "patch"), "match_id")
    counts = rows.groupBy("patch", "champion_id", F.col("team_position").alias("role")).agg(F.count("*").alias("games"))
    order = [F.desc("games"), "champion_id", "role"]
    top = counts.withColumn("_n", F.row_number().over(Window.partitionBy("patch").orderBy(*order))).where(F.col("_n") <= max(25, n))
    return top.withColumn("place", F.row_number().over(Window.partitionBy("patch", "role").orderBy(*order))).where(F.col("place") <= per_role).drop("_n")


def grid_counts(matches: DataFrame, participants: DataFrame, bans: DataFrame, ranks: DataFrame) -> DataFrame:
    """Counts of every role and of all roles, for each tier, EMERALD_PLUS and all
    players, in one pass: each row counts in each scope that it belongs to."""
    rows = ranked_rows(matches, participants).join(solo_ranks(ranks), "puuid", "left")
    tiers = F.array_compact(F.array(F.lit("ALL"), F.col("tier"), F.when(F.col("tier").isin(EMERALD_PLUS), "EMERALD_PLUS")))
    roles = F.array(F.lit("ALL"), F.col("team_position"))
    scopes = F.flatten(F.transform(roles, lambda r: F.transform(tiers, lambda t: F.struct(r.alias("role"), t.alias("rank_scope")))))
    return tier_counts(rows.select("patch", "match_id", "champion_id", "win", scopes.alias("scopes")), bans)


def analytics_grid(matches: DataFrame, participants: DataFrame, bans: DataFrame, ranks: DataFrame, minimum: int | Sample = 100) -> DataFrame:
    """Tier lists of every role and tier."""
    return scores_of(grid_counts(matches, participants, bans, ranks), minimum)


def refresh_grid(mart: VersionedTable, matches: DataFrame, participants: DataFrame, bans: DataFrame, ranks: DataFrame, batch: int) -> None:
    """Adds a batch of new matches to a mart of grid counts, by patch. Read are the
    batch's rows and the counts of its patches, however many matches have landed
    before. A match lands once, and a batch that is applied again changes nothing.
    Players count with the rank that they had when their match was added."""
    own = matches.select("match_id").distinct()
    new = grid_counts(matches, *(df.join(own, "match_id", "left_semi") for df in (participants, bans)), ranks)
    mart.fold(new, added_counts, batch)


def of_popular(mart: DataFrame, popular: DataFrame, per_role: int = 12) -> DataFrame:
    """The rows of a mart (win rates, builds, matchups) for the first champions of
    each patch and role."""
    first = popular.where(F.col("place") <= per_role).select("patch", "champion_id", "role")
    return mart.join(first, ["patch", "champion_id", "role"], "left_semi")


#: Platforms of a region of the roster; others are their own.
ROSTER_PLATFORMS = {"NA": ["NA1"], "EUW": ["EUW1"], "KR": ["KR"], "CN": ["CN1", "CN2"]}


def pro_rows(matches: DataFrame, participants: DataFrame, roster: DataFrame, summoners: DataFrame, region: str | None = None, role: str | None = None) -> DataFrame:
    name = (region or "").strip().upper()
    if name not in ("", "ALL"):
        roster = roster.where(F.upper("platform_region").isin(ROSTER_PLATFORMS.get(name, [name])))
    named = roster.where("is_active").join(summoners.select("puuid", "game_name", "tag_line"), "puuid", "left")
    full = F.when(F.col("tag_line").isNotNull(), F.concat("game_name", F.lit("#"), "tag_line")).otherwise(F.col("game_name"))
    named = named.select("puuid", F.coalesce("pro_name", full).alias("player"), "team_name", F.col("platform_region").alias("platform"))
    return ranked_rows(matches, participants, role=role).join(named, "puuid")


def item_lists(items: DataFrame) -> DataFrame:
    return items.where("item_id <> 0").groupBy("match_id", "participant_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))


def pro_recent_matches(matches: DataFrame, participants: DataFrame, roster: DataFrame, summoners: DataFrame, items: DataFrame, n: int = 25, region: str | None = None, role: str | None = None) -> DataFrame:
    """The newest n ranked games of roster players per champion and patch."""
    order = Window.partitionBy("patch", "champion_id").orderBy(F.desc("match_date"), F.desc("match_id"), "participant_id")
    rows = pro_rows(matches, participants, roster, summoners, region, role).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return rows.join(item_lists(items), ["match_id", "participant_id"], "left").select("patch", "champion_id", "place", "match_id", "participant_id", "match_date", "player", "team_name", "team_position", "win", F.coalesce("items", F.array().cast("array<int>")).alias("items"))


def pro_top_players(matches: DataFrame, participants: DataFrame, roster: DataFrame, summoners: DataFrame, n: int = 10, region: str | None = None, role: str | None = None) -> DataFrame:
    groups = pro_rows(matches, participants, roster, summoners, region, role).groupBy("patch", "champion_id", "player", "team_name").agg(F.count("*").alias("games"), F.count_if("win").alias("wins"))
    order = Window.partitionBy("patch", "champion_id").orderBy(F.desc("games"), F.desc(F.col("wins") / F.col("games")), "player", "team_name")
    return groups.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).withColumn("win_rate", F.col("wins") / F.col("games"))


def pro_common_builds(matches: DataFrame, participants: DataFrame, roster: DataFrame, summoners: DataFrame, items: DataFrame, n: int = 10, region: str | None = None, role: str | None = None) -> DataFrame:
    rows = pro_rows(matches, participants, roster, summoners, region, role).join(item_lists(items), ["match_id", "participant_id"]).withColumn("item_key", F.concat_ws(",", F.col("items").cast("array<string>")))
    groups = rows.groupBy("patch", "champion_id", "item_key").agg(F.count("*").alias("games"), F.count_if("win").alias("wins"))
    order = Window.partitionBy("patch", "champion_id").orderBy(F.desc("games"), F.desc(F.col("wins") / F.col("games")), "item_key")
    return groups.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).withColumn("win_rate", F.col("wins") / F.col("games"))


def pro_feed(recent: DataFrame, popular: DataFrame, champions: int = 8, each: int = 8, total: int = 48) -> DataFrame:
    """Newest pro games of the most played champions, one row a match and
    champion."""
    most = popular.groupBy("patch", "champion_id").agg(F.sum("games").alias("games"))
    most = most.withColumn("_n", F.row_number().over(Window.partitionBy("patch").orderBy(F.desc("games"), "champion_id"))).where(F.col("_n") <= champions).select("patch", "champion_id")
    rows = recent.where(F.col("place") <= each).join(most, ["patch", "champion_id"])
    once = Window.partitionBy("patch", "match_id", "champion_id").orderBy("participant_id")
    rows = rows.withColumn("_k", F.row_number().over(once)).where("_k = 1")
    order = Window.partitionBy("patch").orderBy(F.desc("match_date"), F.desc("match_id"), "champion_id")
    return rows.withColumn("feed_place", F.row_number().over(order)).where(F.col("feed_place") <= total).select("patch", "feed_place", "champion_id", "match_id", "player", "win")


def tier_board(tiers: DataFrame, top: int = 8, trending: int = 3) -> DataFrame:
    """Entries of known grades with a rank that runs on over the grades, and
    whether they are among the first or the best by win rate."""
    clean = tiers.where(F.col("grade").isin(GRADES) & (F.col("champion_id") > 0)).withColumn("score", F.nanvl(F.coalesce("score", F.lit(0.0)), F.lit(0.0)))
    own = Window.partitionBy("patch", "role")
    rank = F.row_number().over(own.orderBy(F.desc(grade_value(F.col("grade"))), F.desc("score"), "champion_id"))
    trend = F.row_number().over(own.orderBy(F.desc("win_rate"), F.desc("games"), "champion_id"))
    return clean.select("patch", "role", "champion_id", "grade", "games", "win_rate", rank.alias("global_rank"), trend.alias("trend_rank")).withColumn("rate_grade", grade_of_rate(F.col("win_rate"))).withColumn("is_top", F.col("global_rank") <= top).withColumn("is_trending", F.col("trend_rank") <= trending)


def main_role(winrates: DataFrame) -> DataFrame:
    """A champion's most played role and that role's most played tier row."""
    roles = winrates.groupBy("patch", "champion_id", "role").agg(F.sum("games").alias("role_games"), F.max_by("rank_tier", F.struct("games", "rank_tier")).alias("tier_of_most"), F.max("games").alias("tier_games"))
    order = Window.partitionBy("patch", "champion_id").orderBy(F.desc("role_games"), "role")
    return roles.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def matchup_index(role_tiers: DataFrame, n: int = 120, per_role: int = 48) -> DataFrame:
    """The most played (champion, role) entries with all roles of the champion."""
    order = [F.desc("games"), "champion_id", "role"]
    top = role_tiers.withColumn("_n", F.row_number().over(Window.partitionBy("patch").orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    roles = top.groupBy("patch", "champion_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("role"))).alias("roles"))
    shown = top.withColumn("place", F.row_number().over(Window.partitionBy("patch", "role").orderBy(*order))).where(F.col("place") <= per_role)
    return shown.join(roles, ["patch", "champion_id"]).select("patch", "role", "place", "champion_id", "games", "roles")


def unit_win_percents(matches: DataFrame, participants: DataFrame, items: DataFrame, runes: DataFrame, ranks: DataFrame) -> DataFrame:
    """Games and win rate of every item and rune by champion, lane and tier. A
    participant's units become one set each before they meet the games."""
    key = ["match_id", "participant_id"]
    rows = ranked_rows(matches, participants).join(solo_ranks(ranks), "puuid", "left").select("patch", "champion_id", F.col("team_position").alias("lane"), F.coalesce("tier", F.lit("UNRANKED")).alias("rank_tier"), *key, "win")
    held = items.where("item_id > 0").groupBy(*key).agg(F.collect_set(F.struct(F.lit("item").alias("kind"), F.col("item_id").alias("unit"))).alias("i"))
    chosen = runes.where("rune_id > 0").groupBy(*key).agg(F.collect_set(F.struct(F.lit("rune").alias("kind"), F.col("rune_id").alias("unit"))).alias("r"))
    none = F.array().cast("array<struct<kind:string,unit:int>>")
    units = rows.join(held, key, "left").join(chosen, key, "left").select("patch", "champion_id", "lane", "rank_tier", "win", F.explode(F.concat(F.coalesce("i", none), F.coalesce("r", none))).alias("u"))
    return units.groupBy("patch", "champion_id", "lane", "rank_tier", "u.kind", "u.unit").agg(F.count("*").alias("games"), (F.count_if("win") / F.count("*")).alias("win_rate"))
