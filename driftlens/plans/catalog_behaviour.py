"""Gap statistics, behaviour likelihood and coordination."""

from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.operators import behaviour as bh
from driftlens.operators import coordination as co
from driftlens.operators import evaluate as ev
from driftlens.operators import gaps as gp
from driftlens.plans.catalog import query, r6, sql_ts
from driftlens.plans.views import Views, with_views

AUTHOR = ["platform", "author_id"]
WEEK = 7 * 86_400
MIN_POSTS, MIN_ACCOUNTS = 10, 8


def _entropy_sql(keys: str, source: str) -> str:
    """Normalised entropy of gap bins per key."""
    position = "least(floor(12 * log10(least(greatest(gap_s, 1.0), 86400.0)) / log10(86400.0)), 11)"
    return f"""SELECT {keys}, CASE WHEN sum(c) < 2 THEN 1.0 ELSE -sum(c / t * log2(c / t)) / log2(12) END AS gap_entropy FROM (
        SELECT *, sum(c) OVER (PARTITION BY {keys}) AS t FROM (SELECT {keys}, {position} AS bin, count(*) AS c FROM {source} WHERE gap_s IS NOT NULL GROUP BY {keys}, bin)) GROUP BY {keys}"""


_BURSTINESS = "CASE WHEN count(gap_s) < 2 THEN 0.0 ELSE coalesce((stddev_pop(gap_s) - avg(gap_s)) / nullif(stddev_pop(gap_s) + avg(gap_s), 0), 0.0) END"


def account_gaps(v: Views):
    return gp.inter_post_gaps(v.posts_core, AUTHOR)


@query("w01_inter_post_gaps", with_views(["v_gaps"], "SELECT post_id, round(coalesce(gap_s, -1), 3) AS gap_s FROM v_gaps"))
def _(v: Views):
    return account_gaps(v).select("post_id", F.round(F.coalesce("gap_s", F.lit(-1.0)), 3).alias("gap_s"))


@query("g09_burstiness", with_views(["v_gaps"], f"SELECT platform, author_id, round({_BURSTINESS}, 6) AS burstiness FROM v_gaps GROUP BY 1, 2"))
def _(v: Views):
    return gp.gap_statistics(account_gaps(v), AUTHOR).select(*AUTHOR, r6("burstiness").alias("burstiness"))


@query("g10_gap_entropy", with_views(["v_gaps"], f"SELECT platform, author_id, round(gap_entropy, 6) AS gap_entropy FROM ({_entropy_sql('platform, author_id', 'v_gaps')})"))
def _(v: Views):
    return gp.gap_statistics(account_gaps(v), AUTHOR).select(*AUTHOR, r6("gap_entropy").alias("gap_entropy"))


@query("g11_synchrony", with_views(["v_gaps"], "SELECT platform, author_id, round(count(*) FILTER (gap_s <= 3600) / count(*), 6) AS synchrony FROM v_gaps GROUP BY 1, 2"))
def _(v: Views):
    return gp.gap_statistics(account_gaps(v), AUTHOR, window=3600).select(*AUTHOR, r6("synchrony").alias("synchrony"))


@query("w02_seen_before", with_views(["v_posts"], """
    SELECT post_id, row_number() OVER (PARTITION BY platform, author_id, text_hash ORDER BY created_at, post_id) > 1 AS seen_before FROM v_posts"""))
def _(v: Views):
    return bh.seen_before(v.hashed_posts.drop("text_key")).select("post_id", "seen_before")


@query("g21_template_share", with_views(["v_template"], "SELECT platform, author_id, round(template, 6) AS template_share FROM v_template"))
def _(v: Views):
    return bh.template_share(v.hashed_posts, 17).withColumn("template_share", r6("template_share"))


@query("g22_night_and_young", with_views(["v_night"], "SELECT platform, author_id, round(night_share, 6) AS night_share, young FROM v_night"))
def _(v: Views):
    return bh.night_and_young(v.posts_core, v.accounts).withColumn("night_share", r6("night_share"))


@query("c07_behaviour_likelihood", with_views(["v_behaviour"], """
    SELECT platform, account_id, round(likelihood, 6) AS likelihood, round(regularity, 4) AS regularity, round(template, 4) AS template, round(night_share, 4) AS night_share FROM v_behaviour"""))
def _(v: Views):
    d = v.behaviour_plan()
    return d.select("platform", "account_id", r6("likelihood").alias("likelihood"), *[F.col(f"features.{c}").alias(c) for c in ("regularity", "template", "night_share")])


@query("c08_baseline_age_ratio", with_views(["v_core", "v_accounts"], """
    SELECT DISTINCT account_id FROM v_accounts a JOIN (SELECT author_id, min(created_at) AS first FROM v_core GROUP BY 1) ON author_id = account_id
    WHERE a.created_at IS NOT NULL AND floor((epoch_us(first) - epoch_us(a.created_at)) / 86400e6) < 180 AND coalesce(followers, 0) / greatest(1, coalesce(following, 1)) < 300"""))
def _(v: Views):
    return bh.baseline_age_ratio(v.posts_core, v.accounts, max_days=180, max_ratio=300)


@query("w12_exact_duplicate_bursts", with_views(["v_posts"], """
    SELECT DISTINCT p.author_id AS account_id FROM v_posts p JOIN (
      SELECT q.text_hash, q.created_at FROM v_posts q JOIN v_posts r ON r.text_hash = q.text_hash AND r.created_at <= q.created_at
        AND epoch_us(q.created_at) - epoch_us(r.created_at) <= 86400 * 1000000::BIGINT GROUP BY q.text_hash, q.created_at HAVING count(DISTINCT r.author_id) >= 4) w
    ON w.text_hash = p.text_hash AND p.created_at <= w.created_at AND epoch_us(w.created_at) - epoch_us(p.created_at) <= 86400 * 1000000::BIGINT"""))
def _(v: Views):
    return bh.exact_duplicate_bursts(v.hashed_posts.drop("text_key"), seconds=86_400, min_accounts=4)


# -- coordination: same text within a clock week ------------------------------
_NODE = "platform || ':' || post_id"
_SLOT = f"CAST(floor(epoch_us(created_at) / {WEEK}e6) AS BIGINT)"
_CLUSTERS = {
    "grp": f"SELECT *, {_NODE} AS node, min({_NODE}) OVER (PARTITION BY text_key, {_SLOT}) AS cluster, count(*) OVER (PARTITION BY text_key, {_SLOT}) AS size FROM v_posts",
    "cl": f"SELECT * FROM grp WHERE size >= {MIN_POSTS}",
    "cgap": "SELECT *, epoch_us(created_at) / 1e6 - lag(epoch_us(created_at) / 1e6) OVER (PARTITION BY cluster ORDER BY created_at, platform, post_id) AS gap_s FROM cl",
    "agap": "SELECT *, epoch_us(created_at) / 1e6 - lag(epoch_us(created_at) / 1e6) OVER (PARTITION BY cluster, author_id ORDER BY created_at, post_id) AS gap_s FROM cl",
    "acc": f"SELECT cluster, author_id, count(*) AS n_posts, CASE WHEN count(*) >= 3 THEN greatest(0.0, -({_BURSTINESS})) ELSE 0.0 END AS regularity FROM agap GROUP BY 1, 2",
    "dup": """SELECT cluster, sum(CASE WHEN a > 1 THEN n ELSE 0 END) / sum(n) AS dup_ratio FROM (SELECT cluster, text_key, count(*) AS n, count(DISTINCT author_id) AS a FROM cl GROUP BY 1, 2) GROUP BY 1""",
    "feat": f"""SELECT cluster, n_posts, n_accounts, hn, burstiness, sync, dup_ratio, regular_share FROM
        (SELECT cluster, count(*) AS n_posts, {_BURSTINESS} AS burstiness, count(*) FILTER (gap_s <= 60) / count(*) AS sync FROM cgap GROUP BY 1)
        JOIN (SELECT cluster, gap_entropy AS hn FROM ({_entropy_sql('cluster', 'cgap')})) USING (cluster) JOIN dup USING (cluster)
        JOIN (SELECT cluster, count(*) AS n_accounts, sum(CASE WHEN regularity >= 0.5 THEN n_posts ELSE 0 END) / sum(n_posts) AS regular_share FROM acc GROUP BY 1) USING (cluster)""",
    "cscore": f"""SELECT *, 1 / (1 + exp(-(2 * sync + 2 * (1 - hn) + greatest(0.0, -burstiness) + 1.5 * dup_ratio + 3 * regular_share - 4))) AS score FROM feat WHERE n_accounts >= {MIN_ACCOUNTS}""",
    "cosync": """SELECT cluster, author_id, avg(hit::INT) AS co_sync FROM (SELECT cluster, author_id, EXISTS (SELECT 1 FROM cl q WHERE q.cluster = p.cluster AND q.text_key = p.text_key
        AND q.author_id <> p.author_id AND abs(epoch_us(q.created_at) - epoch_us(p.created_at)) <= 43200 * 1000000::BIGINT) AS hit FROM cl p) GROUP BY 1, 2""",
    "ascore": """SELECT cluster, author_id AS account_id, co_sync, regularity, n_posts, dup_ratio, 1 / (1 + exp(-(2.5 * co_sync + 2 * regularity + 2 * least(1.0, (n_posts - 1) / 3.0) + dup_ratio - 3.5))) AS score
        FROM cosync JOIN acc USING (cluster, author_id) JOIN dup USING (cluster)""",
}


def _coordination_sql(body: str, views=()) -> str:
    return with_views(["v_posts", *views], body, _CLUSTERS)


def grouped(v: Views):
    """Posts with their text group, without texts; written once, since every step of the detector reads them."""
    return v.stage("grouped", lambda: v.hashed_posts.select(
        "platform", "post_id", "author_id", "created_at", "origin_post_id", "hashtags", F.col("text_key").alias("text_group")))


def week_links(v: Views):
    return co.narrative_links(grouped(v), text_slot=WEEK, use=("text",))


def week_clusters(v: Views):
    return v.stage("week_clusters", lambda: co.narrative_clusters(grouped(v), week_links(v), MIN_POSTS))


def week_features(v: Views):
    return v.stage("week_features", lambda: co.cluster_features(grouped(v), week_clusters(v)))


def week_account_features(v: Views):
    return v.stage("week_account_features", lambda: co.account_features(grouped(v), week_clusters(v), week_features(v), seconds=43_200))


@query("c01_narrative_links", with_views(["v_posts"], f"""
    SELECT {_NODE} AS src, head AS dst FROM (SELECT *, min({_NODE}) OVER (PARTITION BY text_key, {_SLOT}) AS head FROM v_posts) WHERE {_NODE} <> head
    UNION ALL SELECT {_NODE}, head FROM (SELECT *, min({_NODE}) OVER (PARTITION BY tag, CAST(floor(epoch_us(created_at) / 1800e6) AS BIGINT)) AS head FROM v_posts) WHERE {_NODE} <> head
    UNION ALL SELECT c.platform || ':' || c.post_id, o.platform || ':' || o.post_id FROM v_posts c JOIN v_posts o ON o.post_id = c.origin_post_id"""))
def _(v: Views):
    return co.narrative_links(grouped(v), tags="hashtags", text_slot=WEEK)


@query("c02_narrative_clusters", _coordination_sql("SELECT platform, post_id, cluster FROM cl"))
def _(v: Views):
    return co.narrative_clusters(grouped(v), week_links(v), MIN_POSTS)


@query("g12_cross_account_dup_ratio", _coordination_sql("SELECT cluster, round(dup_ratio, 6) AS dup_ratio FROM dup"))
def _(v: Views):
    d = grouped(v).join(week_clusters(v), ["platform", "post_id"])
    return co.cross_account_duplicates(d).withColumn("dup_ratio", r6("dup_ratio"))


@query("c03_cluster_score", _coordination_sql("""
    SELECT cluster, n_posts, n_accounts, round(hn, 6) AS hn, round(burstiness, 6) AS burstiness, round(sync, 6) AS sync, round(dup_ratio, 6) AS dup_ratio, round(score, 6) AS score FROM cscore WHERE score >= 0.05"""))
def _(v: Views):
    d = co.score_clusters(co.cluster_features(grouped(v), week_clusters(v)), min_accounts=MIN_ACCOUNTS, threshold=0.05)
    return d.select("cluster", "n_posts", "n_accounts", *[r6(c).alias(c) for c in ("hn", "burstiness", "sync", "dup_ratio", "score")])


@query("g13_regular_share", _coordination_sql("SELECT cluster, round(regular_share, 6) AS regular_share FROM feat"))
def _(v: Views):
    return week_features(v).select("cluster", r6("regular_share").alias("regular_share"))


@query("g14_mode_topic", _coordination_sql("""
    SELECT cluster, max_by(topic_id, (n, -topic_id)) AS topic_id FROM (SELECT cluster, topic_id, count(*) AS n FROM cl JOIN v_assign USING (platform, post_id) GROUP BY 1, 2) GROUP BY 1""", ["v_assign"]))
def _(v: Views):
    return co.mode_topic(grouped(v), week_clusters(v), v.assign)


@query("c04_co_sync", _coordination_sql("SELECT cluster, author_id AS account_id, round(co_sync, 6) AS co_sync FROM cosync"))
def _(v: Views):
    return co.co_sync(grouped(v), week_clusters(v), seconds=43_200).withColumn("co_sync", r6("co_sync"))


@query("c05_account_score", _coordination_sql("SELECT cluster, account_id, round(co_sync, 6) AS co_sync, round(regularity, 6) AS regularity, n_posts, round(score, 6) AS score FROM ascore"))
def _(v: Views):
    d = co.score_accounts(co.account_features(grouped(v), week_clusters(v), week_features(v), seconds=43_200))
    return d.select("cluster", "account_id", r6("co_sync").alias("co_sync"), r6("regularity").alias("regularity"), "n_posts", r6("score").alias("score"))


# -- the same over all kinds of links; the queries above are checked by SQL on text links
def all_clusters(v: Views):
    return v.stage("all_clusters", lambda: co.narrative_clusters(grouped(v), co.narrative_links(grouped(v), tags="hashtags", text_slot=WEEK), MIN_POSTS))


def all_features(v: Views):
    return v.stage("all_features", lambda: co.cluster_features(grouped(v), all_clusters(v)))


@query("c02_narrative_clusters_all_links")
def _(v: Views):
    return all_clusters(v)


@query("g12_cross_account_dup_ratio_all_links")
def _(v: Views):
    return co.cross_account_duplicates(grouped(v).join(all_clusters(v), ["platform", "post_id"])).withColumn("dup_ratio", r6("dup_ratio"))


@query("c03_cluster_score_all_links")
def _(v: Views):
    d = co.score_clusters(all_features(v), min_accounts=MIN_ACCOUNTS, threshold=0.05)
    return d.select("cluster", "n_posts", "n_accounts", *[r6(c).alias(c) for c in ("hn", "burstiness", "sync", "dup_ratio", "score")])


@query("g13_regular_share_all_links")
def _(v: Views):
    return all_features(v).select("cluster", r6("regular_share").alias("regular_share"))


@query("g14_mode_topic_all_links")
def _(v: Views):
    return co.mode_topic(grouped(v), all_clusters(v), v.assign)


@query("c04_co_sync_all_links")
def _(v: Views):
    return co.co_sync(grouped(v), all_clusters(v), seconds=43_200).withColumn("co_sync", r6("co_sync"))


@query("c05_account_score_all_links")
def _(v: Views):
    d = co.score_accounts(co.account_features(grouped(v), all_clusters(v), all_features(v), seconds=43_200))
    return d.select("cluster", "account_id", r6("co_sync").alias("co_sync"), r6("regularity").alias("regularity"), "n_posts", r6("score").alias("score"))


@query("c06_run_coordination")
def _(v: Views):
    """The whole detector with near-duplicate text groups."""
    posts = v.posts.select("platform", "post_id", "author_id", "created_at", "origin_post_id", "hashtags", "text", "text_key")
    _clusters, accounts = co.run_coordination(posts, v.assign, tags="hashtags", text_slot=WEEK, min_posts=MIN_POSTS, min_accounts=MIN_ACCOUNTS, threshold=0.05)
    return accounts.select("platform", "account_id", "cluster", r6("score").alias("score"), "reasons.co_sync", "reasons.cluster_score")


@query("g26_cluster_evidence", with_views(["v_core", "v_assign", "v_clusters", "v_coord"], f"""
    SELECT cluster, post_id, rank, {sql_ts('created_at')} AS created_at FROM (SELECT k.cluster, c.post_id, c.created_at, row_number() OVER (PARTITION BY k.cluster ORDER BY c.created_at, c.platform, c.post_id) AS rank
      FROM v_core c JOIN v_assign USING (platform, post_id) JOIN v_clusters k USING (topic_id) JOIN v_coord a ON a.cluster = k.cluster AND a.platform = c.platform AND a.account_id = c.author_id AND a.score >= 0.7)
    WHERE rank <= 25"""))
def _(v: Views):
    d = co.cluster_evidence(v.posts_core, v.assign, v.coord_clusters, v.coord_accounts)
    return d.select("cluster", "post_id", "rank", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def _ablation_sql() -> str:
    cw = {"sync": "sync", "concentration": "(1 - hn)", "regularity": "greatest(0.0, -burstiness)", "dup_ratio": "dup_ratio", "regular_share": "regular_share"}
    aw = {"co_sync": "co_sync", "regularity": "regularity", "repetition": "least(1.0, (n_posts - 1) / 3.0)", "cluster_dup": "a.dup_ratio"}
    variants = [("full model", None, None)] + [(f"cluster -{n}", n, None) for n in cw] + [(f"account -{n}", None, n) for n in aw]
    parts = []
    for name, c0, a0 in variants:
        c = " + ".join(f"{0.0 if n == c0 else fixed.CLUSTER_WEIGHTS[n]} * {e}" for n, e in cw.items())
        a = " + ".join(f"{0.0 if n == a0 else fixed.ACCOUNT_WEIGHTS[n]} * {e}" for n, e in aw.items())
        parts.append(f"""SELECT '{name}' AS variant, account_id FROM ascore a WHERE 1 / (1 + exp(-({a} - 3.5))) >= 0.3
          AND cluster IN (SELECT cluster FROM feat WHERE n_accounts >= {fixed.MIN_CLUSTER_ACCOUNTS} AND 1 / (1 + exp(-({c} - 4))) >= 0.3)""")
    union = " UNION ALL ".join(parts)
    names = ", ".join(f"'{v[0]}'" for v in variants)
    return f"""SELECT variant, tp, fp, n - tp AS fn FROM (SELECT variant, count(DISTINCT account_id) FILTER (account_id IN (SELECT account_id FROM v_flagged)) AS tp,
        count(DISTINCT account_id) FILTER (account_id NOT IN (SELECT account_id FROM v_flagged)) AS fp FROM (SELECT unnest([{names}]) AS variant) LEFT JOIN ({union}) USING (variant) GROUP BY 1),
        (SELECT count(DISTINCT account_id) AS n FROM v_flagged)"""


@query("m05_weight_ablation", _coordination_sql(_ablation_sql(), ["v_flagged"]))
def _(v: Views):
    d = ev.weight_ablation(week_features(v), week_account_features(v), v.flagged, threshold=0.3)
    return d.select("variant", "tp", "fp", "fn")
