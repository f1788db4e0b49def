"""The daily feed of all users in one job.

Profiles become token clauses, equal clauses are looked up once in the posting
tokens, and everything after that is per-row columns and windows by user.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import company as CO, fixed as V, geo as G, keywords as KW, scoring as S, text as T, tokens as K
from ..functions.base import at, bound, col, hours_between, text, ts
from ..sources.tables import checkpointed
from . import core as C
from .search import SEARCHED, excluded_words, fold_actions, haystack, match_clauses, stage_prefilter


def build_profiles(prefs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One profile per user: preferences win, the resume fills the gaps, industries are joined."""
    c = candidates.select("user_id", *[F.col(x).alias("c_" + x) for x in candidates.columns if x != "user_id"])
    j = prefs.join(c, "user_id", "left")
    u = S.unique_strings
    either = lambda a, b: F.when(F.size(u(a)) > 0, u(a)).otherwise(u(b))
    scope = F.when(F.col("job_scope").isin("overseas", "all"), F.col("job_scope")).otherwise("domestic")
    english = scope.isin("overseas", "all") & F.coalesce("c_has_en_resume", F.lit(False))
    j = j.withColumn("_cn_roles", either("target_roles", "c_target_roles")).withColumn("_cn_words", u("target_keywords")).withColumn("_cn_skills", u("c_skills"))
    pick = lambda en, cn: F.when(english, either(en, cn)).otherwise(F.col(cn))
    regions = F.array_distinct(F.array_compact(F.transform(F.coalesce("target_regions", F.array().cast("array<string>")), _region)))
    default = F.array(*[F.lit(r) for r in V.DEFAULT_OVERSEAS_REGIONS])
    stage = F.coalesce("experience_stage", "c_experience_stage")
    best = F.array_max(F.transform(F.concat(F.coalesce("c_education", F.array().cast("array<string>")),
                                            F.array(F.coalesce("c_education_summary", F.lit("")))), T.education_rank))
    level = F.when(best >= 6, "博士").when(best == 5, "硕士").when(best == 4, "本科").when(best == 3, "大专")
    limit = F.least(F.lit(30), F.greatest(F.lit(5), F.coalesce(F.col("daily_limit").cast("int"), F.lit(20))))
    out = j.select(
        "user_id", scope.alias("profile_scope"),
        F.when(scope == "domestic", F.array().cast("array<string>")).when(F.size(regions) > 0, regions).otherwise(default).alias("target_regions"),
        pick("c_en_target_roles", "_cn_roles").alias("target_roles"), pick("c_en_target_keywords", "_cn_words").alias("target_keywords"),
        u("exclude_keywords").alias("exclude_keywords"), either("target_locations", "c_target_locations").alias("target_locations"),
        u("target_companies").alias("target_companies"),
        u(F.concat(F.coalesce("target_industries", F.array().cast("array<string>")), F.coalesce("c_industries", F.array().cast("array<string>")))).alias("target_industries"),
        pick("c_en_skills", "_cn_skills").alias("skills"), F.when(stage.isin("实习", "校招", "社招"), stage).otherwise("").alias("stage"),
        F.col("c_seniority").alias("seniority"), level.alias("highest_education"), limit.alias("daily_limit"))
    return out.withColumn("ready", (F.size("target_roles") + F.size("target_keywords") + F.size("target_companies")) > 0)


def _region(x: Column) -> Column:
    k = F.lower(F.trim(x))
    chain = None
    for alias, r in V.REGION_ALIASES.items():
        chain = F.when(k == alias, r) if chain is None else chain.when(k == alias, r)
    return chain


def with_query_sets(profiles: DataFrame, groups=None, overseas: bool = False) -> DataFrame:
    """Profiles with their words read once: role_q, keyword_q, user_fns, target_categories, company keys."""
    # stored once: every use of a profile would repeat its expressions, and the plans of the feed would not fit the driver
    p = checkpointed(profiles.withColumn("_roles", F.concat("target_roles", "target_keywords")))
    read = checkpointed(read_words(p, ["_roles", "target_keywords", "target_roles"], KW.vocabulary(groups, overseas), overseas))
    for words, name, what in (("_roles", "role_q", "q"), ("target_keywords", "keyword_q", "q"), ("target_roles", "_fns", "fn")):
        mine = read.select(F.col("words").alias("_words"), F.col("read")[what].alias(name))
        p = p.join(mine, F.col(words) == F.col("_words"), "left").drop("_words")
    p = (p.withColumn("user_fns", F.array_distinct(F.filter("_fns", lambda f: f != "其他")))
         .withColumn("target_categories", KW.target_categories("target_industries"))
         .withColumn("target_company_keys", F.transform("target_companies", CO.cover_key)))
    return checkpointed(p.select(*profiles.columns, "role_q", "keyword_q", "user_fns", "target_categories", "target_company_keys"))


def read_words(df: DataFrame, columns, groups, overseas: bool) -> DataFrame:
    """(words, read) per distinct array of words: query features q and function fn of each, in order; a word is read once."""
    lists = df.select(F.explode(F.array(*columns)).alias("words")).where("words is not null").distinct()
    each = lists.select("words", F.posexplode("words").alias("_pos", "_word"))
    known = each.select("_word").distinct().select(
        F.col("_word").alias("_known"), F.struct(KW.query_features(F.col("_word"), groups, overseas).alias("q"), T.job_function(F.col("_word"), None).alias("fn")).alias("_read"))
    by_list = (each.join(known, F.col("_word").eqNullSafe(F.col("_known"))).groupBy("words")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_read"))), lambda x: x["_read"]).alias("read")))
    empty = lists.where(F.size("words") == 0).join(by_list.select("read").limit(0), F.lit(True), "left").select("words", F.coalesce("read", F.array().cast(by_list.schema["read"].dataType)).alias("read"))
    return by_list.unionByName(empty)


def profile_clauses(profiles: DataFrame) -> DataFrame:
    """(user_id, tier, tokens, ckey): role words expanded by the vocabulary, companies, cities."""
    of = lambda c: KW.clauses_of(F.col(c))
    role = KW.clauses_of(F.flatten(F.transform("role_q", lambda q: q["terms"])))
    tiers = F.array(F.struct(F.lit("role").alias("tier"), role.alias("cl")), F.struct(F.lit("company").alias("tier"), of("target_companies").alias("cl")),
                    F.struct(F.lit("cityNew").alias("tier"), of("target_locations").alias("cl")))
    rows = profiles.where("ready").select("user_id", F.explode(tiers).alias("t")).select("user_id", "t.tier", F.explode("t.cl").alias("tokens"))
    return rows.withColumn("ckey", F.array_join("tokens", " ")).dropDuplicates(["user_id", "tier", "ckey"])


def with_search_doc(jobs: DataFrame) -> DataFrame:
    return jobs if "search_doc" in jobs.columns else jobs.withColumn("search_doc", K.search_doc("title", "company", "location", "job_type"))


def scope_ok() -> Column:
    """Posting scope against the profile scope and its regions, as columns of a pair row."""
    loc = F.lower(text("location"))
    region = F.exists("target_regions", lambda r: F.when(r == "Remote", (text("country_code") == "") & (loc.contains("remote") | loc.contains("远程")))
                      .otherwise(F.upper(text("country_code")) == r))
    return (F.when(F.col("profile_scope") == "domestic", F.coalesce("job_scope", F.lit("domestic")) == "domestic")
             .when(F.col("profile_scope") == "all", True).otherwise((text("job_scope") == "overseas") & region))


def _key(*cols) -> Column:
    """One short key of equal values, nulls and arrays included."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


#: what a user's tests read of a posting; postings of one cell differ for them in time and id only
CELL = ["location", "country_code", "job_scope", "_stages", "_cities", "_new"]


def _newest() -> list[Column]:
    return [F.col("first_seen_at").desc(), F.col("id"), F.col("_row")]


def recall(profiles: DataFrame, jobs: DataFrame, actions: DataFrame, now, budget: int = V.RECALL_BUDGET) -> DataFrame:
    """Candidate postings per user (user_id, id, tier): three tiers drawn in turn up to the budget.

    The first occurrence of a posting in a user's draw is kept. Users are never paired with all their matches: the postings of a
    wish (the clauses of a tier) are ranked per cell, users of equal profiles share one list, and lists are read to a depth.
    Whoever is left with too few rows by exclusions or own actions, although the list goes on, is drawn again four times deeper.
    """
    since = at(now) - F.expr("interval 7 days")
    live = with_search_doc(jobs).where((F.col("status") == "active") & (F.col("last_seen_at") >= since)
                                       & (F.length(F.trim("summary")) >= V.MIN_SUMMARY_CHARS))
    clauses = checkpointed(profile_clauses(profiles).where("user_id is not null"))
    users = checkpointed(_askers(profiles, clauses))
    asked = users.dropDuplicates(["class"])
    wishes = asked.select(F.explode("wants").alias("_w")).select("_w.wish", F.explode("_w.ckeys").alias("ckey")).distinct()
    posts, hits = _posts_in_cells(live, clauses, since)
    acted = actions.where("action <> 'viewed'").select("user_id", F.col("job_id").alias("id")).distinct()
    todo, depth, parts = users.select("user_id", "class"), 2 * budget, []
    while True:
        part, todo = _draw(todo, asked, wishes, posts, hits, acted, live, budget, depth)
        parts.append(part)
        if todo.isEmpty():
            break
        depth *= 4
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _askers(profiles: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row per user: wants (tier, wish, ckeys), tests (a row per profile row), words, cities; ``class`` is equal for equal profiles."""
    wants = (clauses.groupBy("user_id", "tier").agg(F.array_sort(F.collect_set("ckey")).alias("ckeys"))
             .groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("tier", _key("ckeys").alias("wish"), "ckeys"))).alias("wants")))
    words = excluded_words("exclude_keywords")
    test = F.struct("profile_scope", "target_regions", "stage", (F.size(words) > 0).alias("_excludes"))
    tests = profiles.groupBy("user_id").agg(F.array_sort(F.collect_list(test)).alias("tests"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))).alias("words"))
    out = wants.join(tests, "user_id").withColumn("class", _key("wants", "tests", "words"))
    cities = F.flatten(F.transform(F.filter("wants", lambda w: w["tier"] == "cityNew"), lambda w: w["ckeys"]))
    return out.withColumn("cities", cities)


def _posts_in_cells(live: DataFrame, clauses: DataFrame, since) -> tuple[DataFrame, DataFrame]:
    """Postings (id, _row, first_seen_at, _cell and its columns) and the (ckey, id) hits of the clauses."""
    stages = F.array_compact(F.array(*[F.when(stage_prefilter(s), F.lit(s)) for s in V.STAGE_PATTERNS]))
    loc = F.lower(text("location"))
    # of a place only what scope_ok and the nearness ask: blank, remote or other
    place = F.when(F.trim(text("location")) == "", "").when(loc.contains("remote") | loc.contains("远程"), "remote").otherwise("other")
    narrow = checkpointed(live.select("id", "search_doc", place.alias("location"), F.upper(text("country_code")).alias("country_code"), "job_scope", "first_seen_at",
                                      stages.alias("_stages"), F.coalesce(F.col("first_seen_at") >= since, F.lit(False)).alias("_new"))
                          .withColumn("_row", F.monotonically_increasing_id()))
    hits = checkpointed(match_clauses(narrow, clauses).distinct())
    cities = hits.join(clauses.where("tier = 'cityNew'").select("ckey").distinct(), "ckey", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("ckey")).alias("_cities"))
    posts = narrow.drop("search_doc").join(cities, "id", "left").withColumn("_cities", F.coalesce("_cities", F.array().cast("array<string>")))
    return checkpointed(posts.withColumn("_cell", _key(*CELL))), hits


def _draw(todo: DataFrame, asked: DataFrame, wishes: DataFrame, posts: DataFrame, hits: DataFrame, acted: DataFrame, live: DataFrame, budget: int,
          depth: int) -> tuple[DataFrame, DataFrame]:
    """Draws of the users (user_id, class) whose lists of ``depth`` rows suffice, and the other users."""
    asked = asked.join(todo.select("class").distinct(), "class", "left_semi")
    lists = checkpointed(_class_lists(asked, wishes, posts, hits, depth))
    words = asked.select("class", F.explode("words").alias("_word"))
    kept = checkpointed(without_excluded(lists.where(F.col("_pos") <= depth), words, live, "class"))
    cut = lists.where(F.col("_pos") > depth).select("class", "_tier")
    # a tier needs no more rows than the budget
    left = kept.groupBy("class", "_tier").agg(F.count("*").alias("_n"))
    short = cut.join(left, ["class", "_tier"], "left").where(F.coalesce("_n", F.lit(0)) < budget).select("class").distinct()
    first = checkpointed(_drawn(kept.join(short, "class", "left_anti"), "class", budget))
    ready = todo.join(short, "class", "left_anti")
    # actions change a draw only where they are on drawn postings
    mine = acted.join(ready, "user_id")
    own = checkpointed(mine.join(first.select("class", "id"), ["class", "id"], "left_semi").select("user_id", "class").distinct())
    rows = checkpointed(_handed(own, kept).join(acted, ["user_id", "id"], "left_anti"))
    left = rows.groupBy("user_id", "_tier").agg(F.count("*").alias("_n"))
    late = own.join(cut, "class").join(left, ["user_id", "_tier"], "left").where(F.coalesce("_n", F.lit(0)) < budget).select("user_id", "class").distinct()
    late = checkpointed(late)
    own_drawn = _drawn(rows.join(late, "user_id", "left_anti"), "user_id", budget)
    done = _handed(ready.join(own, "user_id", "left_anti"), first).select("user_id", "id", "tier").unionByName(own_drawn.select("user_id", "id", "tier"))
    return done, todo.join(short, "class", "left_semi").unionByName(late)


def _class_lists(asked: DataFrame, wishes: DataFrame, posts: DataFrame, hits: DataFrame, depth: int) -> DataFrame:
    """The first depth + 1 candidates (_pos) of each class and tier, exclusions and actions aside."""
    # within a cell all classes share one order, so a list never needs more of a cell than its own depth
    used = wishes.join(asked.select(F.explode("wants").alias("_w")).select("_w.wish").distinct(), "wish", "left_semi")
    rows = hits.join(used.select("ckey").distinct(), "ckey", "left_semi").join(posts.select("id", "_row", "first_seen_at", "_cell"), "id")
    rows = C.top_n_per(rows, ["ckey", "_cell"], _newest(), depth + 1).join(used, "ckey").drop("ckey").distinct()
    rows = checkpointed(C.top_n_per(rows, ["wish", "_cell"], _newest(), depth + 1))
    sizes = rows.groupBy("wish", "_cell").agg(F.count("*").alias("_n")).join(posts.select("_cell", *CELL).dropDuplicates(["_cell"]), "_cell")
    who = asked.select("class", "tests", "cities", F.explode("wants").alias("_w")).select("class", "cities", "_w.tier", "_w.wish", F.explode("tests").alias("_t"))
    pairs = who.select("class", "cities", "tier", "wish", "_t.*").join(sizes, "wish")
    staged = ~F.coalesce(F.col("stage").isin(list(V.STAGE_PATTERNS)), F.lit(False)) | F.array_contains("_stages", F.col("stage"))
    # users without target cities have no near or far: newest first
    near = (F.when((F.size("cities") == 0) | (F.col("tier") == "cityNew"), 0).when(F.arrays_overlap("cities", "_cities"), 0)
             .when(F.col("location") == "", 1).otherwise(2))
    pairs = pairs.where(scope_ok() & staged & ((F.col("tier") != "cityNew") | F.col("_new"))).select(
        "class", "tier", "wish", "_cell", "_n", "_excludes", near.alias("_near"), F.when(F.col("_new"), 0).otherwise(1).alias("_old"),
        F.when(F.col("tier") == "role", 0).when(F.col("tier") == "company", 1).otherwise(2).alias("_tier"))
    # cells behind cells that fill the list by themselves are not read
    own = Window.partitionBy("class", "tier")
    before = F.sum("_n").over(own.orderBy("_near", "_old")) - F.sum("_n").over(Window.partitionBy("class", "tier", "_near", "_old"))
    pairs = pairs.withColumn("_before", before).where(F.col("_before") <= depth)
    out = pairs.select("class", "tier", "_tier", "_near", "_excludes", "wish", "_cell").join(rows, ["wish", "_cell"]).drop("wish", "_cell")
    # rows of excluding profiles first among equals, so that a cut never parts them from the others
    order = [F.col("_near"), *_newest(), F.col("_excludes").desc()]
    return C.numbered(out, ["class", "_tier"], order, "_pos").where(F.col("_pos") <= depth + 1)


def _drawn(rows: DataFrame, owner: str, budget: int) -> DataFrame:
    drawn = C.weighted_round_robin(rows, [owner], "_tier", [F.col("_pos")], weight_of("_tier"), budget)
    return C.latest_per_key(drawn, [owner, "id"], [F.col("tier_rn") / weight_of("_tier"), F.col("_tier")]).select(owner, "id", "tier")


#: users of a class that one task hands a list to
USERS_PER_LIST = 1000


def _handed(users: DataFrame, lists: DataFrame) -> DataFrame:
    """Each user (user_id, class) with the rows of the class; large classes are dealt to several copies of the list."""
    parts = users.groupBy("class").agg(F.ceil(F.count("*") / USERS_PER_LIST).cast("int").alias("_parts"))
    dealt = users.join(parts, "class").select("user_id", "class", F.pmod(F.xxhash64("user_id"), F.col("_parts")).cast("int").alias("_part"))
    copies = lists.join(parts, "class").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copies, ["class", "_part"]).drop("_part")


#: exclusion words that are searched in one copy of a text
WORDS_PER_SCAN = 200


def without_excluded(rows: DataFrame, words: DataFrame, jobs: DataFrame, owner: str) -> DataFrame:
    """Candidate rows (owner, id, _excludes) whose posting names none of the owner's exclusion words (owner, _word).

    Texts meet words once per posting, not once per pair: the distinct words of all owners who could see a posting go to its text
    in lots of WORDS_PER_SCAN, and only (posting, word) hits come back.
    """
    asked = rows.where("_excludes").select(owner, "id").distinct().join(words, owner)
    lots = -(-words.select("_word").distinct().count() // WORDS_PER_SCAN) or 1
    lots = asked.select("id", "_word").distinct().groupBy("id", F.pmod(F.xxhash64("_word"), F.lit(lots)).alias("_lot")).agg(F.collect_list("_word").alias("_words"))
    lots = checkpointed(lots)
    # only the texts of candidates are folded
    texts = jobs.select("id", *SEARCHED).join(lots.select("id").distinct(), "id", "left_semi").select("id", haystack(*SEARCHED).alias("_text")).join(lots, "id")
    hits = texts.select("id", F.explode(F.filter("_words", lambda w: F.col("_text").contains(w))).alias("_word"))
    gone = asked.join(hits, ["id", "_word"], "left_semi").select(owner, "id").distinct()
    return rows.join(gone, [owner, "id"], "left_anti").drop("_excludes")


def weight_of(tier_no) -> Column:
    return F.when(F.col(tier_no) == 0, 5.0).when(F.col(tier_no) == 1, 2.0).otherwise(3.0)


def with_posting_facts(jobs: DataFrame, sources: DataFrame, overrides=None, groups=None, overseas: bool = False) -> DataFrame:
    """What a posting says, read once for all users."""
    gs = KW.vocabulary(groups, overseas)
    j = KW.with_posting_features(jobs, gs).withColumn("_senior", T.asks_experience("title", "experience", "summary"))
    a = ("title", "job_type", "summary", "jd_url", "company")
    j = (j.withColumn("category", T.recruitment_category(*a, senior=F.col("_senior"))).withColumn("explicit", T.has_explicit_type(*a, senior=F.col("_senior")))
          .withColumn("company_key", CO.cover_key("company")).drop("_senior"))
    s = sources.select(F.col("id").alias("source_id"), F.col("enabled").alias("source_enabled"), "crawl_method")
    return j.join(s, "source_id", "left").join(KW.company_industry(jobs, overrides), "company", "left")


def score_pairs(pairs: DataFrame, profiles: DataFrame, facts: DataFrame, actions: DataFrame, now) -> DataFrame:
    """Facts, gate, score and signals of candidate pairs."""
    act = fold_actions(actions).select("user_id", F.col("job_id").alias("id"), "primary_action", "viewed")
    p = profiles.withColumns(S.profile_reads()).drop("ready", "seniority")
    facts = facts.withColumns(S.posting_reads())
    # the wide posting side comes last, so texts are shuffled once per posting and never per pair
    rows = pairs.join(p, "user_id").join(act, ["user_id", "id"], "left").join(facts, "id")
    keep = ["user_id", "id", "title", "company", "location", "status", "first_seen_at", "enrich_checked_at", "deadline", "daily_limit",
            "primary_action", "viewed", "stage", "category"]
    f = bound(rows, "_m", F.struct(*S.match_facts(now))).select(*keep, "_m.*")
    f = bound(f, "_e", S.eligibility()).select("*", "_e.reject_reason", "_e.degraded").drop("_e")
    f = bound(f, "score", F.when(F.col("reject_reason").isNull(), S.opportunity_score()))
    job_stage = F.when(F.col("stage_state").isin("match", "mismatch"), F.col("category"))
    return (f.withColumn("tier", S.score_tier("score")).withColumn("reasons", S.reasons())
             .withColumn("signals", S.signals(now, "stage", job_stage)).withColumn(
                 "explore_ok", F.coalesce((F.col("role_tier") == "related") | F.col("company_hit"), F.lit(False))))


def scored_candidates(profiles: DataFrame, jobs: DataFrame, sources: DataFrame, actions: DataFrame, now, overrides=None, groups=None, overseas: bool = True) -> DataFrame:
    """score_pairs of the candidates of all users (profiles of with_query_sets)."""
    pairs = checkpointed(recall(profiles, jobs, actions, now).select("user_id", "id"))
    # only postings that are a candidate of someone are read in depth
    wanted = jobs.join(checkpointed(pairs.select("id").distinct()), "id", "left_semi")
    return score_pairs(pairs, profiles, with_posting_facts(wanted, sources, overrides, groups, overseas), actions, now)


def filtered_counts(scored: DataFrame) -> DataFrame:
    """Why candidates do not show, per user."""
    r = F.col("reject_reason")
    return scored.groupBy("user_id").agg(
        F.count("*").alias("screened"), F.count_if(r.isin("inactive", "stale", "source_disabled")).alias("inactive"),
        F.count_if(r == "thin_summary").alias("thin"),
        F.count_if(r.isNotNull() & ~r.isin("inactive", "stale", "source_disabled", "thin_summary", "already_actioned")).alias("mismatch"),
        F.count_if(r.isNull() & F.col("tier").isNull()).alias("low_score"))


def critical_alerts(actions: DataFrame, jobs: DataFrame, now, profiles: DataFrame | None = None) -> DataFrame:
    """Saved or applied postings that closed or close soon."""
    watched = actions.where("action in ('saved', 'applied')")
    last = C.latest_per_key(watched, ["user_id", "job_id"], [F.col("created_at").desc(), F.col("event_id").desc()])
    rows = last.select("user_id", F.col("job_id").alias("id"), F.col("action").alias("primary_action")).join(jobs, "id")
    rows = rows.join(profiles.select("user_id", "stage"), "user_id", "left") if profiles is not None else rows.withColumn("stage", F.lit(""))
    rows = rows.withColumn("signals", S.signals(now, "stage", None, watched=True))
    return rows.where(F.exists("signals", lambda s: s["critical"]))


MAIN_SIGNALS = ["STILL_OPEN", "OPEN_UNVERIFIED", "DEADLINE_SOON"]


def _grouping(opps: DataFrame) -> DataFrame:
    """Columns the grouping works with: primary signal, criticality, thresholds, display rank, key."""
    first = F.get("signals", F.lit(0))
    o = (opps.withColumn("primary_type", first["type"]).withColumn("primary_priority", F.coalesce(first["priority"], F.lit(99)))
         .withColumn("is_critical", F.exists("signals", lambda s: s["critical"]))
         .withColumn("threshold", F.when(F.col("intensity") == "active", 45).otherwise(70))
         .withColumn("is_main", F.coalesce(F.col("primary_type").isin(MAIN_SIGNALS), F.lit(False)))
         .withColumn("semantic", S.semantic_key("company", "title", "location", "id")))
    explore = (F.col("intensity") == "active") & F.col("is_main") & F.col("explore_ok") & (F.col("score") >= 30) & (F.col("score") < F.col("threshold"))
    waiting = (F.col("primary_type") == "CLOSED_OR_STALE") & ~F.col("is_critical")
    return o.withColumn("display_rank", F.when(F.col("is_critical"), 0).when(F.col("is_main") & (F.col("score") >= F.col("threshold")), 1)
                        .when(explore, 2).when(waiting, 3).otherwise(4))


def score_order() -> list[Column]:
    return [F.col("score").desc(), F.col("first_seen_at").desc_nulls_last(), F.col("id")]


def semantic_dedupe(opps: DataFrame) -> DataFrame:
    """One row per user and same company, title and place: the best displayed one survives."""
    urgent = F.when(F.col("display_rank") == 0, F.col("primary_priority")).otherwise(0)
    return C.latest_per_key(opps, ["user_id", "semantic"], [F.col("display_rank"), urgent, *score_order()])


def section_feed(opps: DataFrame, explore_cap: int = V.EXPLORE_CAP, waiting_cap: int = V.WAITING_CAP) -> DataFrame:
    """Sections critical (all), main, explore, waiting with their limits and company spread.

    Sections are disjoint by the display rank, so each posting is placed once.
    """
    o = semantic_dedupe(_grouping(opps))
    section = F.when(F.col("display_rank") == 0, "critical").when(F.col("display_rank") == 1, "main").when(F.col("display_rank") == 2, "explore").when(
        F.col("display_rank") == 3, "waiting")
    limit = (F.when(F.col("section") == "main", F.when(F.col("intensity") == "active", F.col("daily_limit"))
                    .otherwise(F.greatest(F.lit(5), F.least(F.col("daily_limit"), F.lit(10)))))
              .when(F.col("section") == "explore", explore_cap).when(F.col("section") == "waiting", waiting_cap).otherwise(2147483647))
    o = o.withColumn("section", section).where("section is not null").withColumn("_limit", limit)
    spread = F.col("section").isin("main", "explore")
    cap = F.when(spread, F.greatest(F.lit(2), F.ceil(F.col("_limit") * 0.3))).otherwise(2147483647)
    name = S.semantic_part("company")
    o = o.withColumn("_co", F.when(name == "", F.concat(F.lit("id:"), F.col("id").cast("string"))).otherwise(name)).withColumn("_cap", cap)
    urgent = F.when(F.col("section") == "critical", F.col("primary_priority")).otherwise(0)
    out = C.spread_then_fill(o, ["user_id", "section"], ["_co"], [urgent, *score_order()], F.col("_cap"), F.col("_limit"))
    return out.withColumnRenamed("pick", "position").drop("_limit", "_cap", "_co")


def diverse_top(opps: DataFrame, owner, group: str, order, limit: int) -> DataFrame:
    """Top rows with at most max(2, 30 %) per group, refilled from the rest."""
    import math
    return C.spread_then_fill(opps, owner, [group], order, max(2, math.ceil(limit * 0.3)), limit)


def daily_feed(profiles: DataFrame, jobs: DataFrame, sources: DataFrame, actions: DataFrame, now, radar: DataFrame | None = None,
               overrides=None, groups=None, overseas: bool = True) -> DataFrame:
    """Displayed postings of every user by section and position.

    ``radar`` gives intensity and last_opened_at per user; without it everyone is active.
    """
    p = with_query_sets(profiles.where("ready"), groups, overseas)
    actions = checkpointed(actions)
    scored = scored_candidates(p, jobs, sources, actions, now, overrides, groups, overseas).where("reject_reason is null and tier is not null")
    state = radar if radar is not None else p.select("user_id").withColumn("intensity", F.lit("active")).withColumn("last_opened_at", F.lit(None).cast("timestamp"))
    cols = ["user_id", "id", "title", "company", "location", "status", "first_seen_at", "daily_limit", "score", "signals", "explore_ok"]
    alerts = critical_alerts(actions, jobs, now, p).join(p.select("user_id", "daily_limit"), "user_id").withColumn("score", F.lit(100)).withColumn("explore_ok", F.lit(False))
    opps = scored.select(*cols).unionByName(alerts.select(*cols)).join(state, "user_id", "left").withColumn("intensity", F.coalesce("intensity", F.lit("active")))
    out = section_feed(opps)
    return out.withColumn("is_new", F.coalesce(F.col("first_seen_at") > F.col("last_opened_at"), F.lit(False)))


def user_lists(actions: DataFrame, jobs: DataFrame, kind: str) -> DataFrame:
    """Saved or applied postings with their present state; a vanished one keeps its snapshot."""
    mine = C.latest_per_key(actions.where(F.col("action") == kind), ["user_id", "job_id"], [F.col("created_at").desc(), F.col("event_id").desc()])
    j = jobs.select(F.col("id").alias("job_id"), F.col("title").alias("_t"), F.col("company").alias("_c"), F.col("status").alias("_s"))
    snap = lambda k: F.get_json_object("snapshot", f"$.{k}") if "snapshot" in actions.columns else F.lit(None).cast("string")
    return mine.join(j, "job_id", "left").select("user_id", "job_id", "created_at", F.coalesce("_t", snap("title")).alias("title"),
                                                 F.coalesce("_c", snap("company")).alias("company"), F.coalesce("_s", F.lit("gone")).alias("status"))


def merge_recall(preferred: DataFrame, fallback: DataFrame, order, target: int = 200, min_preferred: int = 50) -> DataFrame:
    """Preferred postings per user, filled from the fallback only where too few are there."""
    n = preferred.groupBy("user_id").agg(F.count("*").alias("_n"))
    fill = fallback.join(n, "user_id", "left").where(F.coalesce("_n", F.lit(0)) < min_preferred).drop("_n")
    both = preferred.withColumn("_part", F.lit(0)).unionByName(fill.withColumn("_part", F.lit(1)))
    first = C.latest_per_key(both, ["user_id", "id"], [F.col("_part")])
    return C.top_n_per(first, ["user_id"], [F.col("_part"), *order], target).drop("_part")
