"""Filters, joins, set operations, ordering, similarity and search."""

from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.sequence import top_n_per_group, with_previous
from driftlens.operators import alerts as al
from driftlens.operators import coordination as co
from driftlens.operators import demographics as dm
from driftlens.operators import filters as fl
from driftlens.operators import graph as gr
from driftlens.operators import lineage as ln
from driftlens.operators import links, search
from driftlens.operators import timelines as tl
from driftlens.operators import topics as tp
from driftlens.plans.catalog import query, r6, sql_ts, ts
from driftlens.plans.views import GAZETTEER_CHARS, Views, with_views

MID = "2024-01-15 00:00:00"


# -- filters -----------------------------------------------------------------
@query("f01_organic_only", with_views(["v_flagposts"], "SELECT platform, post_id, author_id FROM v_flagposts WHERE NOT coordinated"))
def _(v: Views):
    return fl.organic_only(v.posts_core, v.flagged).select("platform", "post_id", "author_id")


@query("f02_organic_flag", with_views(["v_flagposts"], "SELECT platform, post_id, coordinated AS is_coordinated FROM v_flagposts"))
def _(v: Views):
    return fl.organic_flag(v.posts_core, v.flagged).select("platform", "post_id", "is_coordinated")


@query("f03_filter_posts", with_views(["v_posts", "v_assign", "v_flagged"], f"""
    SELECT platform, post_id, {sql_ts('created_at')} AS created_at FROM v_posts p JOIN v_assign a USING (platform, post_id)
    WHERE platform = 'x' AND topic_id = 3 AND created_at <= TIMESTAMP '{MID}'
      AND list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), 'the')
      AND NOT EXISTS (SELECT 1 FROM v_flagged f WHERE f.platform = p.platform AND f.account_id = p.author_id)
    ORDER BY p.created_at DESC, platform, post_id LIMIT 100"""))
def _(v: Views):
    d = fl.filter_posts(v.posts, assign=v.assign, flagged=v.flagged, platform="x", to_ts=MID, topic_id=3, terms=["the"])
    return d.select("platform", "post_id", ts("created_at").alias("created_at"))


@query("f04_filter_kind", with_views(["v_core"], """
    SELECT 'comments' AS part, count(*) AS n FROM v_core WHERE kind IN ('reply', 'comment') UNION ALL
    SELECT 'posts', count(*) FROM v_core WHERE kind NOT IN ('reply', 'comment') UNION ALL SELECT 'all', count(*) FROM v_core"""))
def _(v: Views):
    parts = [fl.filter_kind(v.posts_core, k).agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k in ("comments", "posts", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f05_in_topic", with_views(["v_core", "v_assign"], "SELECT platform, post_id, author_id FROM v_core JOIN v_assign USING (platform, post_id) WHERE topic_id = 2"))
def _(v: Views):
    return fl.in_topic(v.posts_core, v.assign, 2).select("platform", "post_id", "author_id")


@query("f06_since", with_views(["v_edges"], f"SELECT kind, count(*) AS n, {sql_ts('min(ts)')} AS first FROM v_edges WHERE ts >= TIMESTAMP '{MID}' GROUP BY 1"))
def _(v: Views):
    return fl.since(v.edges, MID).groupBy("kind").agg(F.count("*").alias("n"), ts(F.min("ts")).alias("first"))


@query("f07_orphan_replies", with_views(["v_core"], """
    SELECT count(*) AS orphan_replies FROM (SELECT parent_post_id || CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS parent FROM v_core WHERE parent_post_id IS NOT NULL)
    WHERE parent NOT IN (SELECT post_id FROM v_core)"""))
def _(v: Views):
    """Parents of even posts are renamed, so that they count as uncollected."""
    lost = F.when(F.col("event_id") % 2 == 0, F.concat("parent_post_id", F.lit("x"))).otherwise(F.col("parent_post_id"))
    return fl.orphan_replies(v.posts_core.withColumn("parent_post_id", lost))


@query("f08_min_threshold", with_views(["v_behaviour"], "SELECT platform, account_id FROM v_behaviour WHERE likelihood >= 0.17"))
def _(v: Views):
    return fl.min_threshold(v.behaviour, "likelihood", 0.17).select("platform", "account_id")


# -- joins -------------------------------------------------------------------
@query("j01_posts_topics", with_views(["v_core", "v_assign"], "SELECT topic_id, platform, count(*) AS n FROM v_core JOIN v_assign USING (platform, post_id) GROUP BY 1, 2"))
def _(v: Views):
    return tl.with_topic(v.posts_core, v.assign).groupBy("topic_id", "platform").agg(F.count("*").alias("n"))


@query("j02_posts_topics_emotions", with_views(["v_core", "v_assign", "v_emo"], """
    SELECT topic_id, count(*) AS n, round(avg(anxiety), 6) AS anxiety FROM v_core LEFT JOIN v_assign USING (platform, post_id)
    LEFT JOIN v_emo USING (platform, post_id) GROUP BY 1"""))
def _(v: Views):
    d = tl.with_emotions(v.posts_core.join(v.assign, fl.POST_KEY, "left"), v.emotions)
    return d.groupBy("topic_id").agg(F.count("*").alias("n"), r6(F.avg("anxiety")).alias("anxiety"))


@query("j03_flagged_exclusion", with_views(["v_accounts", "v_flagged"], """
    SELECT platform, account_id FROM v_accounts a WHERE NOT EXISTS (SELECT 1 FROM v_flagged f WHERE f.platform = a.platform AND f.account_id = a.account_id)"""))
def _(v: Views):
    return v.accounts.join(v.flagged, ["platform", "account_id"], "left_anti").select("platform", "account_id")


@query("j04_topic_membership", with_views(["v_core", "v_assign"], """
    SELECT platform, count(*) AS n FROM v_core WHERE (platform, parent_post_id) IN (SELECT (platform, post_id) FROM v_assign WHERE topic_id = 1) GROUP BY 1"""))
def _(v: Views):
    members = v.assign.where("topic_id = 1").select("platform", F.col("post_id").alias("parent_post_id"))
    return v.posts_core.join(members, ["platform", "parent_post_id"], "left_semi").groupBy("platform").agg(F.count("*").alias("n"))


@query("j05_reply_to_parent", with_views(["v_core"], """
    SELECT c.platform, q.author_id AS replied_to, count(*) AS replies FROM v_core c JOIN v_core q ON q.platform = c.platform AND q.post_id = c.parent_post_id GROUP BY 1, 2"""))
def _(v: Views):
    q = v.posts_core.select("platform", F.col("post_id").alias("parent_post_id"), F.col("author_id").alias("replied_to"))
    replies = v.posts_core.where("parent_post_id IS NOT NULL").groupBy("platform", "parent_post_id").agg(F.count("*").alias("n"))
    return replies.join(q, ["platform", "parent_post_id"]).groupBy("platform", "replied_to").agg(F.sum("n").alias("replies"))


@query("j06_mention_to_account", with_views(["v_edges"], "SELECT src_account, dst_account, count(*) AS n FROM v_edges WHERE kind = 'mention' GROUP BY 1, 2"))
def _(v: Views):
    return v.edges.where("kind = 'mention'").groupBy("src_account", "dst_account").agg(F.count("*").alias("n"))


_SYNC_SQL = """
    SELECT {0} EXISTS (SELECT 1 FROM v_posts q WHERE q.text_key = p.text_key AND q.author_id <> p.author_id
      AND abs(epoch_us(q.created_at) - epoch_us(p.created_at)) <= {1} * 1000000::BIGINT) AS has_partner FROM v_posts p"""


@query("j07_near_in_time_partner", with_views(["v_posts"], _SYNC_SQL.format("post_id,", 259200)))
def _(v: Views):
    """Same text by somebody else within three days."""
    d = v.hashed_posts.select("post_id", "author_id", "created_at", "text_key")
    return co.has_sync_partner(d, ["text_key"], 259_200).select("post_id", "has_partner")


@query("j08_similar_pairs", """
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
    WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.45""")
def _(v: Views):
    vecs = v.table("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return links.similar_pairs(vecs, 0.45).select("a", "b", r6("similarity").alias("similarity"))


_HASH_SQL = """
    SELECT a.phash AS a, b.phash AS b, bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT)) AS hamming
    FROM (SELECT DISTINCT phash FROM v_media) a JOIN (SELECT DISTINCT phash FROM v_media) b ON a.phash < b.phash
    WHERE bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT)) <= {0}"""


@query("j09_similar_hashes", with_views(["v_media"], _HASH_SQL.format(14)))
def _(v: Views):
    return ln.similar_hashes(v.media, 14)


@query("j10_location_to_region", with_views(["v_accounts", "v_gaz"], "SELECT region, count(*) AS n FROM v_accounts JOIN v_gaz ON alias = lower(location_text) GROUP BY 1 HAVING count(*) >= 5"))
def _(v: Views):
    from driftlens.functions.audience import infer_region

    d = infer_region(v.accounts, v.gazetteer, GAZETTEER_CHARS).where("region IS NOT NULL").groupBy("region").agg(F.count("*").alias("n"))
    return d.where("n >= 5")


@query("j11_posts_in_bursts", with_views(["v_core", "v_assign", "v_bursts"], f"""
    SELECT topic_id, {sql_ts('start_ts')} AS start_ts, count(*) FILTER (created_at BETWEEN start_ts AND end_ts) AS inside, count(*) FILTER (NOT created_at BETWEEN start_ts AND end_ts) AS outside
    FROM v_core JOIN v_assign USING (platform, post_id) JOIN v_bursts USING (topic_id) GROUP BY 1, 2"""))
def _(v: Views):
    posts = tl.with_topic(v.posts_core, v.assign)
    inside = al.inside_bursts(v.day_bursts, posts).groupBy("topic_id", "start").agg(F.count("*").alias("inside"))
    whole = posts.groupBy("topic_id").agg(F.count("*").alias("_all"))
    d = v.day_bursts.select("topic_id", "start").join(whole, "topic_id").join(inside, ["topic_id", "start"], "left").fillna(0, ["inside"])
    return d.select("topic_id", ts("start").alias("start_ts"), "inside", (F.col("_all") - F.col("inside")).alias("outside"))


@query("j12_posts_records", with_views(["v_core", "v_assign", "v_hashed"], """
    SELECT post_id, topic_id, record_hash FROM v_core JOIN v_assign USING (platform, post_id) LEFT JOIN v_hashed ON seq = ledger_seq"""))
def _(v: Views):
    d = tl.with_topic(v.posts_core, v.assign)
    return d.join(v.raw_records.select(F.col("seq").alias("ledger_seq"), "record_hash"), "ledger_seq", "left").select("post_id", "topic_id", "record_hash")


@query("j13_checkpoints_overlapping", with_views(["v_core", "v_assign"], """
    SELECT DISTINCT topic_id, b + 1 AS checkpoint_id FROM (SELECT topic_id, min(ledger_seq) AS lo, max(ledger_seq) AS hi FROM v_core JOIN v_assign USING (platform, post_id) GROUP BY 1),
      (SELECT DISTINCT (ledger_seq - 1) // 100 AS b, min(ledger_seq) AS f, max(ledger_seq) AS l FROM v_core GROUP BY 1) WHERE l >= lo AND f <= hi"""))
def _(v: Views):
    spans = tl.with_topic(v.posts_core, v.assign).select(F.col("topic_id").alias("alert_id"), "ledger_seq")
    return al.covering_checkpoints(spans, v.checkpoints).select(F.col("alert_id").alias("topic_id"), F.col("id").alias("checkpoint_id"))


@query("j14_covering_checkpoint", with_views(["v_core"], "SELECT ledger_seq AS seq, (ledger_seq - 1) // 100 + 1 AS checkpoint_id FROM v_core"))
def _(v: Views):
    from driftlens.operators.ledger import covering_checkpoint

    return covering_checkpoint(v.raw_records, v.checkpoints)


@query("j17_origin_in_set", with_views(["v_core", "v_assign"], """
    SELECT topic_id, count(*) AS linked FROM v_core c JOIN v_assign USING (platform, post_id)
    WHERE (topic_id, origin_post_id) IN (SELECT (topic_id, post_id) FROM v_assign) GROUP BY 1"""))
def _(v: Views):
    d = tl.with_topic(v.posts_core, v.assign)
    ids = d.select("topic_id", F.col("post_id").alias("origin_post_id")).distinct()
    return d.join(ids, ["topic_id", "origin_post_id"], "left_semi").groupBy("topic_id").agg(F.count("*").alias("linked"))


@query("j18_predecessor", with_views(["v_hashed"], "SELECT seq, coalesce(lag(record_hash) OVER (ORDER BY seq), '') AS previous FROM v_hashed"))
def _(v: Views):
    d = v.raw_records.select(F.lit(0).alias("chain"), "seq", "record_hash")
    out = with_previous(d, ["chain"], ["seq"], F.floor(F.col("seq") / 512).cast("bigint"), {"previous": "record_hash"})
    return out.select("seq", F.coalesce("previous", F.lit("")).alias("previous"))


# -- ordering and top-k ------------------------------------------------------
@query("k01_page_posts", with_views(["v_core"], f"""
    SELECT platform, post_id, {sql_ts('created_at')} AS created_at FROM v_core WHERE created_at < TIMESTAMP '{MID}' ORDER BY v_core.created_at DESC, platform, post_id LIMIT 500"""))
def _(v: Views):
    return fl.page_posts(v.posts_core, cursor=MID, limit=900).select("platform", "post_id", ts("created_at").alias("created_at"))


@query("k03_top_by_group", with_views(["v_core", "v_assign"], """
    SELECT topic_id, author_id, n, rank FROM (SELECT topic_id, author_id, n, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, author_id) AS rank
      FROM (SELECT topic_id, author_id, count(*) AS n FROM v_core JOIN v_assign USING (platform, post_id) GROUP BY 1, 2)) WHERE rank <= 4"""))
def _(v: Views):
    counts = tl.with_topic(v.posts_core, v.assign).groupBy("topic_id", "author_id").agg(F.count("*").alias("n"))
    return top_n_per_group(counts, ["topic_id"], [F.desc("n"), F.col("author_id")], 4)


@query("k05_top_degree_subgraph", with_views(["v_graph"], """
    SELECT src, dst, round(weight, 6) AS weight FROM v_graph WHERE src IN (SELECT id FROM (SELECT id, sum(weight) AS d FROM (SELECT src AS id, weight FROM v_graph
      UNION ALL SELECT dst, weight FROM v_graph) GROUP BY 1 ORDER BY round(d, 6) DESC, id LIMIT 40)) AND dst IN (SELECT id FROM (SELECT id, sum(weight) AS d
      FROM (SELECT src AS id, weight FROM v_graph UNION ALL SELECT dst, weight FROM v_graph) GROUP BY 1 ORDER BY round(d, 6) DESC, id LIMIT 40))"""))
def _(v: Views):
    _nodes, edges = gr.top_degree_subgraph(v.graph, 40)
    return edges.select("src", "dst", r6("weight").alias("weight"))


@query("k06_latest_across_sources", with_views(["v_core"], f"""
    SELECT platform, post_id, {sql_ts('created_at')} AS created_at FROM v_core ORDER BY v_core.created_at DESC, platform, post_id LIMIT 100"""))
def _(v: Views):
    frames = [v.posts_core.where(F.col("platform") == p) for p in ("x", "telegram", "reddit", "youtube")]
    newest, _counts = fl.latest_across_sources(frames)
    return newest.select("platform", "post_id", ts("created_at").alias("created_at"))


@query("k07_default_topic", with_views(["v_nature", "v_assign"], """
    SELECT topic_id FROM v_nature JOIN (SELECT topic_id, count(*) AS n FROM v_assign GROUP BY 1) USING (topic_id) ORDER BY nature = 'manufactured' DESC, n DESC, topic_id LIMIT 1"""))
def _(v: Views):
    return tp.default_topic(v.topics, v.assign)


# -- sets --------------------------------------------------------------------
@query("u01_topic_authors", with_views(["v_core", "v_assign"], """
    SELECT platform, author_id AS account_id FROM v_core JOIN v_assign USING (platform, post_id) WHERE topic_id = 4
    UNION SELECT platform, author_id FROM v_core WHERE (platform, parent_post_id) IN (SELECT (platform, post_id) FROM v_assign WHERE topic_id = 4)"""))
def _(v: Views):
    return dm.topic_authors(v.posts_core, v.assign, 4)


@query("u02_lineage_posts", with_views(["v_core", "v_assign"], """
    SELECT topic_id, platform, post_id FROM inside UNION ALL SELECT w.topic_id, c.platform, c.post_id FROM v_core c JOIN (SELECT DISTINCT topic_id, origin_post_id FROM inside
      WHERE origin_post_id IS NOT NULL AND (topic_id, origin_post_id) NOT IN (SELECT (topic_id, post_id) FROM inside)) w ON w.origin_post_id = c.post_id""",
    {"inside": "SELECT topic_id, platform, post_id, origin_post_id FROM v_core JOIN v_assign USING (platform, post_id)"}))
def _(v: Views):
    return ln.lineage_posts(v.posts, v.assign).select("topic_id", "platform", "post_id")


@query("u03_flagged_vs_truth", with_views(["v_flagged"], """
    SELECT (SELECT count(*) FROM f WHERE account_id IN (SELECT account_id FROM t)) AS tp, (SELECT count(*) FROM f WHERE account_id NOT IN (SELECT account_id FROM t)) AS fp,
      (SELECT count(*) FROM t WHERE account_id NOT IN (SELECT account_id FROM f)) AS fn""",
    {"f": "SELECT DISTINCT account_id FROM v_flagged", "t": "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS account_id FROM labels WHERE quality = 1"}))
def _(v: Views):
    truth = v.table("labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("account_id"))
    return fl.flagged_vs_truth(v.flagged, truth)


@query("u04_interactors", with_views(["v_graph"], """
    SELECT DISTINCT who AS account_id FROM (SELECT src AS who FROM v_graph WHERE dst = '7' UNION ALL
      SELECT b.src FROM v_graph a JOIN v_graph b ON b.dst = a.src WHERE a.dst = '7') WHERE who <> '7'"""))
def _(v: Views):
    return gr.interactors(v.graph, "7")


# -- vectors and search ------------------------------------------------------
@query("v01_hash_embed")
def _(v: Views):
    d = links.hash_embed(v.texts, "doc_id")
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return d.select("doc_id", F.size("vector").alias("dims"), F.round(F.sqrt(size), 3).alias("norm"))


@query("v02_score_unique_then_join", with_views(["v_emo"], "SELECT platform, post_id, anxiety, excitement, supportive, against, sarcasm FROM v_emo"))
def _(v: Views):
    from driftlens.functions.affect import lexicon_scores
    from driftlens.operators.emotions import score_unique_then_join
    from driftlens.plans.views import LEXICON

    d = score_unique_then_join(v.posts, scorer=lambda t: lexicon_scores(t, LEXICON))
    return d.select("platform", "post_id", "anxiety", "excitement", "supportive", "against", "sarcasm")


@query("v03_near_duplicate_groups")
def _(v: Views):
    """Texts per near-duplicate group (cosine of n-gram counts >= 0.9)."""
    groups = links.text_groups(v.texts, fixed.DUPLICATE_SIMILARITY)
    return groups.groupBy("text_group").agg(F.count("*").alias("texts")).where("texts > 1")


@query("v04_connected_components", with_views(["v_media"], "SELECT node, min(reach) AS component FROM walk GROUP BY 1", {
    "edge": _HASH_SQL.format(14), "both_ways": "SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge",
    "walk(node, reach)": "SELECT a, a FROM both_ways UNION SELECT w.node, e.b FROM walk w JOIN both_ways e ON e.a = w.reach"}, recursive=True))
def _(v: Views):
    pairs = ln.similar_hashes(v.media, 14)
    return links.connected_components(pairs, "a", "b")


_IMAGES = {"img": """SELECT media_id, phash, min(created_at) AS first_seen, min_by(platform, (created_at, platform)) AS platform, count(*) AS posts
    FROM v_media JOIN v_post_media USING (media_id) JOIN v_core USING (platform, post_id) GROUP BY 1, 2""",
           "head": "SELECT phash, min_by(media_id, (first_seen, media_id)) AS media_id, min(first_seen) AS first_seen FROM img GROUP BY 1",
           "pairs": """SELECT CASE WHEN (x.first_seen, x.media_id) <= (y.first_seen, y.media_id) THEN x.media_id ELSE y.media_id END AS a,
      CASE WHEN (x.first_seen, x.media_id) <= (y.first_seen, y.media_id) THEN y.media_id ELSE x.media_id END AS b, hamming
    FROM (SELECT a.phash AS pa, b.phash AS pb, bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT)) AS hamming
          FROM head a JOIN head b ON a.phash < b.phash) JOIN head x ON x.phash = pa JOIN head y ON y.phash = pb WHERE hamming <= 10
    UNION ALL SELECT h.media_id, i.media_id, 0 FROM img i JOIN head h USING (phash) WHERE i.media_id <> h.media_id"""}


def image_pairs(v: Views):
    images = ln.media_first_seen(v.media, v.post_media, v.posts_core)
    return ln.similar_images(images, 10)


@query("v05_similar_images", with_views(["v_media", "v_post_media", "v_core"], "SELECT a AS media_id_a, b AS media_id_b, hamming FROM pairs", _IMAGES))
def _(v: Views):
    return image_pairs(v).select("media_id_a", "media_id_b", "hamming")


@query("v06_image_families", with_views(["v_media", "v_post_media", "v_core"], f"""
    SELECT original, media_id, is_original, coalesce(d.hamming, -1) AS hamming, {sql_ts('first_seen')} AS first_seen, posts FROM (
      SELECT f.media_id, f.component, i.first_seen, i.posts, first_value(f.media_id) OVER w AS original, f.media_id = first_value(f.media_id) OVER w AS is_original
      FROM (SELECT node AS media_id, min(reach) AS component FROM walk GROUP BY 1) f JOIN img i USING (media_id)
      WINDOW w AS (PARTITION BY f.component ORDER BY i.first_seen, f.media_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    LEFT JOIN (SELECT a, b, min(hamming) AS hamming FROM (SELECT a, b, hamming FROM pairs UNION ALL SELECT b, a, hamming FROM pairs) GROUP BY 1, 2) d
      ON d.a = original AND d.b = media_id""",
    {**_IMAGES, "both_ways": "SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs",
     "walk(node, reach)": "SELECT a, a FROM both_ways UNION SELECT w.node, e.b FROM walk w JOIN both_ways e ON e.a = w.reach"}, recursive=True))
def _(v: Views):
    d = ln.image_families(image_pairs(v))
    return d.select("original", "media_id", "is_original", F.coalesce("hamming", F.lit(-1)).alias("hamming"),
                    ts("first_seen").alias("first_seen"), "posts")


_TERMS = ["the", "that", "from"]
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
_SCORE = " + ".join(
    f"greatest(ln((n_docs - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * doc_len / avg_len))" for i in range(len(_TERMS)))


@query("v07_search_bm25", with_views(["v_texts"], f"""
    SELECT CAST(doc_id AS VARCHAR) AS post_id, round(-({_SCORE}), 6) AS rank FROM (SELECT doc_id, len(w) AS doc_len, {_TF} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS w FROM v_texts)),
      (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(_TERMS)))}
       FROM (SELECT len(w) AS doc_len, {_TF} FROM (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS w FROM v_texts)))
    WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(_TERMS)))} ORDER BY {_SCORE} DESC, CAST(doc_id AS VARCHAR) LIMIT 200"""))
def _(v: Views):
    docs = v.texts.select(F.lit("text").alias("platform"), F.col("doc_id").cast("string").alias("post_id"), "text")
    return search.search_bm25(docs, ["#The", "that", "from"], limit=500).select("post_id", r6("rank").alias("rank"))


@query("v08_centroid", """
    SELECT label, i - 1 AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value, count(*) AS n FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2""")
def _(v: Views):
    e = v.table("embeddings").select("label", F.col("embedding").alias("vector"))
    return tp.centroid(e, ["label"]).select("label", "n", F.posexplode("vector").alias("dim", "value")).withColumn("value", r6("value"))
