"""Record keeping: tags, entities, memory, calendars and change feeds as tables after their writes, and the reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import relational as op
from marlstone.operators import retrieval as rt
from marlstone.operators.index import fingerprint
from marlstone.operators.vectorindex import VectorIndex
from marlstone.plans.ops import NOW, as_of
from marlstone.plans.registry import query
from marlstone.plans.retrieval import SEM, TOKENS, VECTOR_ID, document_index, fts, vector
from marlstone.sources.tables import table as t
from marlstone.streaming import changes as cd

# ---- writes


@query("tag_documents", "WITH have AS (SELECT doc_id, lang AS slug FROM documents WHERE n_chars > 3000), want AS (SELECT doc_id, s AS slug FROM documents, (VALUES ('en'), ('de'), ('xx'), ('long')) v(s) WHERE source = 'src3'), known AS (SELECT DISTINCT lang AS slug FROM documents) SELECT doc_id, slug, FALSE AS added FROM have UNION ALL SELECT doc_id, slug, TRUE FROM want WHERE slug IN (SELECT slug FROM known) AND (doc_id, slug) NOT IN (SELECT doc_id, slug FROM have)")
def tag_documents(spark, sf_dir, slugs=("en", "de", "xx", "long")):
    """The links after tagging by slug: unknown slugs hit nothing, and a link that is there stays as it is."""
    d = t(spark, sf_dir, "documents")
    have = d.where("n_chars > 3000").select("doc_id", F.col("lang").alias("slug"))
    known = d.select(F.col("lang").alias("slug")).where("slug IS NOT NULL").distinct()
    want = d.where("source = 'src3'").select("doc_id", F.explode(F.array(*[F.lit(s) for s in slugs])).alias("slug")).join(known, "slug", "left_semi")
    return have.withColumn("added", F.lit(False)).unionByName(op.insert_new(have, want.select("doc_id", "slug"), ["doc_id", "slug"]).withColumn("added", F.lit(True)))


@query("link_cases_and_tags", "WITH x AS (SELECT doc_id, doc_id % 4000 AS number FROM documents), link AS (SELECT x.doc_id, 'case' AS kind, CAST(o_orderkey AS VARCHAR) AS target FROM x JOIN orders ON o_orderkey = number), tags AS (SELECT DISTINCT doc_id, 'tag' AS kind, lower(trim(tag)) AS target FROM documents, unnest([source, lang, ' Filed ']) u(tag) WHERE tag IS NOT NULL), parent AS (SELECT doc_id, 'parent', CAST(doc_id - doc_id % 10 AS VARCHAR) FROM documents WHERE doc_id % 10 <> 0 AND doc_id - doc_id % 10 IN (SELECT doc_id FROM documents)) SELECT * FROM link UNION ALL SELECT * FROM tags UNION ALL SELECT * FROM parent")
def link_cases_and_tags(spark, sf_dir):
    """A document's links: to registered cases only, to its tags, which are made where missing, and to a parent that exists."""
    d = t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    cases = t(spark, sf_dir, "orders").select("o_orderkey")
    link = d.join(cases, F.col("doc_id") % 4000 == F.col("o_orderkey")).select("doc_id", F.lit("case").alias("kind"), F.col("o_orderkey").cast("string").alias("target"))
    tag = F.explode(F.array_distinct(F.transform(F.array_compact(F.array("source", "lang", F.lit(" Filed "))), lambda x: F.lower(F.trim(x)))))
    tags = d.select("doc_id", F.lit("tag").alias("kind"), tag.alias("target")).distinct()
    up = d.where("doc_id % 10 <> 0").select("doc_id", (F.col("doc_id") - F.col("doc_id") % 10).alias("p"))
    parent = up.join(d.select(F.col("doc_id").alias("p")), "p", "left_semi").select("doc_id", F.lit("parent").alias("kind"), F.col("p").cast("string").alias("target"))
    return link.unionByName(tags).unionByName(parent)


@query("write_entities", "WITH e AS (SELECT doc_id, source, lower(trim(w)) AS name, CASE WHEN w = upper(w) THEN 'org' ELSE 'person' END AS type FROM documents, unnest([' ' || source, upper(lang), lang, 'x']) u(w) WHERE w IS NOT NULL), k AS (SELECT DISTINCT doc_id, name, type, CASE WHEN doc_id % 2 = 0 THEN 'author' ELSE 'subject' END AS role FROM e WHERE length(name) >= 2) SELECT name, type, count(DISTINCT doc_id) AS documents, count(*) AS mentions, count(*) FILTER (WHERE role = 'author') AS authored FROM k GROUP BY name, type")
def write_entities(spark, sf_dir):
    """Entities by trimmed lower name and type, names under two characters left out; one mention for each entity, document and role."""
    d = t(spark, sf_dir, "documents")
    e = d.select("doc_id", F.explode(F.array_compact(F.array(F.concat(F.lit(" "), "source"), F.upper("lang"), F.col("lang"), F.lit("x")))).alias("w"))
    role = F.when(F.col("doc_id") % 2 == 0, "author").otherwise("subject")
    k = e.select("doc_id", F.lower(F.trim("w")).alias("name"), F.when(F.col("w") == F.upper("w"), "org").otherwise("person").alias("type"), role.alias("role")).where(F.length("name") >= 2).distinct()
    return k.groupBy("name", "type").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("role") == "author").alias("authored"))


@query("memory_table", "WITH m AS (SELECT user_id AS agent, event_type AS key, props AS value, ts AS saved_at, event_id FROM events WHERE event_type <> 'view'), s AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY agent, key ORDER BY saved_at DESC, value) = 1) SELECT agent, key, saved_at FROM s WHERE NOT (key = 'click' AND agent % 2 = 0)")
def memory_table(spark, sf_dir):
    """An agent's keys after saves, where the newest value counts, and deletes."""
    e = t(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("agent"), F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("ts").alias("saved_at"))
    saved = op.latest(e, ["agent", "key"], "saved_at", F.asc("value"))
    gone = saved.where("key = 'click' AND agent % 2 = 0").select("agent", "key")
    return saved.join(gone, ["agent", "key"], "left_anti").select("agent", "key", "saved_at")


@query("satellite_upsert", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CAST(l.quality AS BIGINT), CASE WHEN d.n_chars % 2 = 0 THEN 0 END) AS quality, coalesce(d.source, 'import') AS provider FROM (SELECT * FROM documents WHERE lang <> 'es') d FULL JOIN labels l ON l.doc_id = d.doc_id")
def satellite_upsert(spark, sf_dir):
    """A document's metadata row: new values win, a null one keeps the old, columns marked to be kept stay."""
    old = t(spark, sf_dir, "documents").where("lang <> 'es'").select("doc_id", F.when(F.col("n_chars") % 2 == 0, F.lit(0)).cast("long").alias("quality"), F.col("source").alias("provider"))
    new = t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.lit("import").alias("provider"))
    return op.upsert(old, new, ["doc_id"], {"provider": "keep"})


@query("calendar_upsert", "WITH o AS (SELECT event_id AS id, ts AS start_at, 'confirmed' AS status FROM events WHERE event_type = 'signup' AND event_id % 2 = 0), n AS (SELECT event_id AS id, ts + INTERVAL 1 HOUR AS start_at, CASE WHEN event_id % 5 = 0 THEN 'cancelled' END AS status FROM events WHERE event_type = 'signup' AND event_id % 3 = 0) SELECT coalesce(n.id, o.id) AS id, coalesce(n.start_at, o.start_at) AS start_at, coalesce(n.status, o.status) AS status FROM o FULL JOIN n ON n.id = o.id")
def calendar_upsert(spark, sf_dir):
    """Calendar events by id: moved and cancelled ones overwrite, unnamed values stay."""
    e = t(spark, sf_dir, "events").where("event_type = 'signup'")
    old = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("ts").alias("start_at"), F.lit("confirmed").alias("status"))
    new = e.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.expr("ts + INTERVAL 1 HOUR").alias("start_at"), F.when(F.col("event_id") % 5 == 0, "cancelled").alias("status"))
    return op.upsert(old, new, ["id"])


@query("tag_changes", "WITH c AS (SELECT user_id AS document, event_type AS tag, value > 50 AS present, ts, event_id FROM events) SELECT document, tag FROM c QUALIFY row_number() OVER (PARTITION BY document, tag ORDER BY ts DESC, event_id DESC) = 1 AND present")
def tag_changes(spark, sf_dir):
    """Tags after a log of adding and removing: the newest change of each link counts."""
    c = t(spark, sf_dir, "events").select(F.col("user_id").alias("document"), F.col("event_type").alias("tag"), (F.col("value") > 50).alias("present"), "ts", "event_id")
    return op.latest(c, ["document", "tag"], "ts", F.desc("event_id")).where("present").select("document", "tag")


@query("note_and_task_edits", "SELECT user_id AS id, arg_max(event_type, ts) FILTER (WHERE event_type IN ('click', 'view')) AS note, arg_max(value, ts) FILTER (WHERE event_type = 'purchase') AS amount, CASE WHEN max(ts) FILTER (WHERE event_type = 'purchase') > max(ts) FILTER (WHERE event_type = 'error') THEN 'done' ELSE 'open' END AS status, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id")
def note_and_task_edits(spark, sf_dir):
    """One row for each item: every field has the value of the last edit that named it."""
    e, kind = t(spark, sf_dir, "events"), F.col("event_type")
    last = lambda value, test: F.max_by(F.when(test, value), F.when(test, F.col("ts")))
    done, wrong = F.max(F.when(kind == "purchase", F.col("ts"))), F.max(F.when(kind == "error", F.col("ts")))
    return e.groupBy(F.col("user_id").alias("id")).agg(
        last(kind, kind.isin("click", "view")).alias("note"), last(F.col("value"), kind == "purchase").alias("amount"),
        F.when(done > wrong, "done").otherwise("open").alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
    )


@query("case_metadata_merge", "SELECT o_custkey AS case_id, arg_max(o_orderstatus, o_orderkey) AS status, count(DISTINCT o_orderpriority) AS keys, max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey")
def case_metadata_merge(spark, sf_dir):
    """A case's status is that of its newest change, its metadata the union of all keys."""
    o = t(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("case_id")).agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.countDistinct("o_orderpriority").alias("keys"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("urgent"),
    )


# ---- change feeds


@query("delta_pages", "WITH c AS (SELECT user_id AS k, event_id AS v, event_type, event_id // 1000 AS page FROM events), n AS (SELECT * FROM c WHERE page >= 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1), s AS (SELECT k, max(v) AS v FROM c WHERE page < 2 GROUP BY k) SELECT coalesce(s.k, n.k) AS k, CASE WHEN n.event_type <> 'error' THEN n.v ELSE s.v END AS v, CASE WHEN n.event_type = 'error' THEN n.v END AS deleted_at FROM s FULL JOIN n ON n.k = s.k WHERE s.k IS NOT NULL OR n.event_type <> 'error'")
def delta_pages(spark, sf_dir, size=1000):
    """A change feed read in pages from a cursor: all pages after it make one batch, so a key named in several counts once."""
    e = t(spark, sf_dir, "events").withColumn("page", F.expr(f"event_id div {size}"))
    state = e.where("page < 2").groupBy(F.col("user_id").alias("k")).agg(F.max("event_id").alias("v")).withColumn("deleted_at", F.lit(None).cast("long"))
    later = cd.after_cursor(e, "page", 1).select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("event_id").alias("seq"))
    return cd.apply_changes(state, later, "k", "seq")


@query("delta_resync", "WITH s AS (SELECT doc_id AS k, n_chars AS v FROM documents WHERE lang <> 'es'), n AS (SELECT doc_id AS k, n_chars + 1 AS v FROM documents WHERE source <> 'src1') SELECT coalesce(n.k, s.k) AS k, coalesce(n.v, s.v) AS v, CASE WHEN n.k IS NULL THEN 7 END AS deleted_at FROM s FULL JOIN n ON n.k = s.k")
def delta_resync(spark, sf_dir, stamp=7):
    """An expired cursor: the source is listed anew, and what the listing lacks is marked deleted."""
    d = t(spark, sf_dir, "documents")
    state = d.where("lang <> 'es'").select(F.col("doc_id").alias("k"), F.col("n_chars").alias("v"), F.lit(None).cast("int").alias("deleted_at"))
    return cd.resync(state, d.where("source <> 'src1'").select(F.col("doc_id").alias("k"), (F.col("n_chars") + 1).alias("v")), "k", F.lit(stamp))


@query("settled_files", f"SELECT user_id, CASE WHEN max(ts) > max(now) - INTERVAL 2 HOUR THEN 'waiting' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'processed' END AS route, count(*) AS writes FROM events, {NOW} GROUP BY user_id")
def settled_files(spark, sf_dir):
    """Files of a watched folder: those written lately wait until they are settled, the others go to the finished or the failed ones."""
    e = t(spark, sf_dir, "events")
    g = e.groupBy("user_id").agg(F.max("ts").alias("at"), F.bool_or(F.col("event_type") == "error").alias("bad"), F.count(F.lit(1)).alias("writes"))
    route = F.when(F.expr("at > now - INTERVAL 2 HOUR"), "waiting").when(F.col("bad"), "failed").otherwise("processed")
    return g.crossJoin(F.broadcast(as_of(e))).select("user_id", route.alias("route"), "writes")


@query("after_high_water", "SELECT event_id, user_id FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1)")
def after_high_water(spark, sf_dir):
    """What a poll returns: rows after the last one that was handled, by time and then id."""
    e = t(spark, sf_dir, "events")
    mark = e.where("event_type = 'purchase'").agg(F.max(F.struct("ts", "event_id")).alias("mark"))
    return e.crossJoin(F.broadcast(mark)).where(F.struct("ts", "event_id") > F.col("mark")).select("event_id", "user_id")


# ---- reminders and schedules

SCHEDULES = {0: "@hourly", 1: "@daily", 2: "@weekly", 3: "*/15 * * * *", 4: "0 6 * * *", 5: "0 6 * * 1", 6: "0 6 1 * *", 7: "whenever"}
_SECONDS = "CASE user_id % 8 WHEN 0 THEN 3600 WHEN 1 THEN 86400 WHEN 2 THEN 604800 WHEN 3 THEN 900 WHEN 4 THEN 86400 WHEN 5 THEN 604800 WHEN 6 THEN 2592000 ELSE 86400 END"


def schedule_seconds(schedule):
    """The interval that a schedule stands for, in seconds: names, every n minutes, days of the month, of the week, and hours; a day otherwise."""
    p = F.split(F.trim(schedule), r"\s+")
    at = lambda i: F.get(p, F.lit(i))
    every = F.regexp_extract(schedule, r"^\*/(\d+) \* \* \* \*$", 1)
    five = F.size(p) == 5
    named = F.when(schedule == "@hourly", 3600).when(schedule == "@weekly", 604800).when(schedule == "@monthly", 2592000)
    cron = F.when(five & (every != ""), every.cast("int") * 60).when(five & ((at(2) != "*") | (at(3) != "*")), 2592000).when(five & (at(4) != "*"), 604800)
    return F.coalesce(named, cron, F.lit(86400))


@query("stale_by_schedule", f"SELECT user_id, {_SECONDS} AS seconds, epoch(now) - epoch(last_run) > 2 * {_SECONDS} AS stale FROM (SELECT user_id, max(ts) AS last_run FROM events GROUP BY user_id), {NOW}")
def stale_by_schedule(spark, sf_dir):
    """Agents that have not run for twice the interval of their schedule."""
    e = t(spark, sf_dir, "events")
    schedule = F.create_map(*[x for k, v in SCHEDULES.items() for x in (F.lit(k), F.lit(v))])[(F.col("user_id") % 8).cast("int")]
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_run")).withColumn("seconds", schedule_seconds(schedule)).crossJoin(F.broadcast(as_of(e)))
    since = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_run").cast("timestamp"))
    return last.select("user_id", "seconds", (since > F.col("seconds").cast("long") * 2_000_000).alias("stale"))


_DUE_NOW = "(SELECT max(ts) - INTERVAL 30 MINUTE AS now FROM events WHERE event_type = 'purchase')"


@query("task_reminders", f"WITH m AS (SELECT event_id, event_type, (epoch_us(ts) - epoch_us(now)) / 60e6 AS m FROM events, {_DUE_NOW}) SELECT event_id, 'task' AS kind, r AS before FROM m, unnest([30, 5]) u(r) WHERE event_type = 'purchase' AND abs(m - r) < 1.5 UNION ALL SELECT event_id, 'calendar', r FROM m, unnest([15, 60]) u(r) WHERE event_type = 'signup' AND abs(m - r) < 1")
def task_reminders(spark, sf_dir):
    """Reminders due half an hour before the last task: tasks within a minute and a half of each wanted distance, calendar entries within one of 15 and 60."""
    e = t(spark, sf_dir, "events")
    now = e.where("event_type = 'purchase'").agg((F.max("ts") - F.expr("INTERVAL 30 MINUTE")).alias("now"))
    at = e.crossJoin(F.broadcast(now)).withColumn("m", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("now").cast("timestamp"))) / 60e6)
    due = lambda kind, name, before, near: at.where(F.col("event_type") == kind).select("event_id", F.lit(name).alias("kind"), F.explode(F.array(*[F.lit(b) for b in before])).alias("before"), "m").where(F.abs(F.col("m") - F.col("before")) < near).drop("m")
    return due("purchase", "task", (30, 5), 1.5).unionByName(due("signup", "calendar", (15, 60), 1.0))


# ---- searches


@query("mail_search_all_filters", f"WITH m AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, {TOKENS} AS tok, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INTEGER)) AS sent FROM documents d) SELECT doc_id, source, sent FROM m WHERE source ILIKE '%src1%' AND lang ILIKE '%e%' AND list_contains(tok, 'license') AND sent >= TIMESTAMP '2024-02-01' AND sent < TIMESTAMP '2024-10-30' + INTERVAL 1 DAY AND doc_id % 50 IN (SELECT CAST(o_orderkey AS BIGINT) FROM orders WHERE o_orderstatus = 'O') AND n_chars > 200 AND doc_id IN (SELECT doc_id FROM labels) ORDER BY sent DESC, doc_id LIMIT 20")
def mail_search_all_filters(spark, sf_dir, words="license", sender="src1", recipient="e", start="2024-02-01", end="2024-10-30", status="O", least=200, labelled=True, limit=20):
    """Mail search: words, sender, recipient, both ends of the time, case, size and attachments; a filter that is not given does not count."""
    sent = F.expr("CAST('2024-01-01' AS timestamp_ntz) + make_dt_interval(CAST(doc_id % 300 AS INT))")
    m = t(spark, sf_dir, "documents").withColumn("sent", sent)
    m = op.where_all(
        m,
        tx.matches(tx.terms(F.col("text")), words) if words else None, F.col("source").ilike(f"%{sender}%") if sender else None, F.col("lang").ilike(f"%{recipient}%") if recipient else None,
        F.col("sent") >= F.lit(start).cast("timestamp_ntz") if start else None, F.col("sent") < F.expr(f"CAST('{end}' AS timestamp_ntz) + INTERVAL 1 DAY") if end else None,
        F.col("n_chars") > least if least else None,
    )
    if status:
        m = m.join(t(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select("o_orderkey"), F.col("doc_id") % 50 == F.col("o_orderkey"), "left_semi")
    if labelled:
        m = m.join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return m.select("doc_id", "source", "sent").orderBy(F.desc("sent"), "doc_id").limit(limit)


@query("fulltext_four_fields", f"SELECT doc_id FROM (SELECT doc_id, {TOKENS.replace('text', 'body')} AS tok FROM (SELECT doc_id, concat_ws(' ', source, lang, 'subject' || doc_id % 10, text) AS body FROM documents)) WHERE list_contains(tok, 'subject3') AND list_contains(tok, 'en')")
def fulltext_four_fields(spark, sf_dir, q="subject3 en"):
    """Full text over subject, sender, recipient and body together."""
    body = F.concat_ws(" ", "source", "lang", F.concat(F.lit("subject"), (F.col("doc_id") % 10).cast("string")), "text")
    return t(spark, sf_dir, "documents").where(tx.matches(tx.terms(body), q)).select("doc_id")


_IN_SPACE = "source <> 'src0' AND lang IN ('en', 'de')"
_SPACE = "SELECT doc_id FROM documents WHERE source <> 'src0' AND lang IN ('en', 'de')"


@query("space_fulltext", f"SELECT id AS doc_id, rank FROM {fts(_IN_SPACE)} WHERE rank >= 0.05 ORDER BY rank DESC, doc_id LIMIT 10")
def space_fulltext(spark, sf_dir, q="license public", least=0.05, k=10):
    """Search in a space's own sources and tags, by words."""
    mine = t(spark, sf_dir, "documents").where(_IN_SPACE)
    return document_index(spark, sf_dir).fulltext(q, 40, documents=mine).where(F.col("rank") >= least).select("doc_id", "rank").orderBy(F.desc("rank"), "doc_id").limit(k)


@query("space_hybrid", f"""
WITH s AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rs FROM ({SEM.replace(' ORDER BY', f' WHERE e.vec_id IN ({_SPACE}) ORDER BY')})), f AS (SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS rf FROM {fts(_IN_SPACE)})
SELECT coalesce(s.id, f.id) AS id, round(coalesce(0.7::DOUBLE / (60 + rs), 0) + coalesce(0.3::DOUBLE / (60 + rf), 0), 6) AS score FROM s FULL JOIN f ON f.id = s.id ORDER BY score DESC, id LIMIT 10""")
def space_hybrid(spark, sf_dir, k=10):
    """The same in both ways, fused by rank."""
    mine = t(spark, sf_dir, "documents").where(_IN_SPACE).select("doc_id")
    sem = rt.semantic(t(spark, sf_dir, "embeddings").join(mine.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), vector(spark, sf_dir, VECTOR_ID), 4 * k).select(F.col("vec_id").alias("id"), "similarity")
    ft = document_index(spark, sf_dir).fulltext("license public", 4 * k, documents=mine).select(F.col("doc_id").alias("id"), "rank")
    return rt.rank_fusion(rt.numbered(sem, F.desc("similarity"), F.asc("id")), rt.numbered(ft, F.desc("rank"), F.asc("id")), "id", k).select("id", "score")


_vectors: dict[tuple, tuple[tuple, VectorIndex]] = {}


def vector_index(spark, sf_dir: str) -> VectorIndex:
    """The index of a folder's vectors, written on first use and anew once the table's files have changed."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    key, now = (spark.sparkContext.applicationId, sf_dir), fingerprint(e)
    if key not in _vectors or _vectors[key][0] != now:
        _vectors[key] = (now, VectorIndex.build(e))
    return _vectors[key][1]


@query("semantic_search_approximate")
def semantic_search_approximate(spark, sf_dir, k=5, share=1.0):
    """The best of each query by quantised codes, the survivors ranked exactly.  These vectors have no clusters, so the codes of all lists are read, a sixteenth of the bytes."""
    index = vector_index(spark, sf_dir)
    queries = t(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding")
    found = index.search(queries, k, max(1, round(share * index.lists)))
    return found.select("query_id", F.col("id").alias("vec_id"), "similarity", "rn")


# ---- reports


@query("platform_state", f"WITH f AS (SELECT 'finding' AS kind, event_type AS name, count(*)::DOUBLE AS n FROM events, {NOW} WHERE value > 90 AND ts > now - INTERVAL 7 DAY GROUP BY 2), p AS (SELECT 'approval', o_orderpriority, count(*)::DOUBLE FROM orders WHERE o_orderstatus = 'P' GROUP BY 2), d AS (SELECT 'decision', event_type, count(*)::DOUBLE FROM events, {NOW} WHERE event_type IN ('purchase', 'signup') AND ts > now - INTERVAL 1 DAY GROUP BY 2), w AS (SELECT 'metric', event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1) SELECT * FROM f UNION ALL SELECT * FROM p UNION ALL SELECT * FROM d UNION ALL SELECT * FROM w")
def platform_state(spark, sf_dir):
    """Open findings by kind, approvals that wait, decisions of the last day, and the newest value of each metric."""
    e = t(spark, sf_dir, "events")
    now = e.crossJoin(F.broadcast(as_of(e)))
    count = lambda df, kind, name: df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    parts = [
        count(now.where("value > 90 AND ts > now - INTERVAL 7 DAY"), "finding", "event_type"),
        count(t(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "approval", "o_orderpriority"),
        count(now.where("event_type IN ('purchase', 'signup') AND ts > now - INTERVAL 1 DAY"), "decision", "event_type"),
        op.latest(e, ["event_type"], "ts", F.desc("event_id")).select(F.lit("metric").alias("kind"), F.col("event_type").alias("name"), F.col("value").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("token_statistics", "SELECT user_id, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS mean, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY user_id")
def token_statistics(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(k).alias("tokens"), F.round(F.avg(k), 6).alias("mean"), F.max(k).alias("most"))


@query("hold_counts", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE h) AS held, count(*) FILTER (WHERE NOT h AND n_chars < 500) AS expired, count(*) FILTER (WHERE h AND n_chars < 500) AS held_back FROM (SELECT d.lang, d.n_chars, coalesce(l.toxic = 1, FALSE) AS h FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY lang")
def hold_counts(spark, sf_dir):
    """Documents on hold, those past their time, and those that only the hold keeps."""
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").withColumn("h", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    old = F.col("n_chars") < 500
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("h").alias("held"), F.count_if(~F.col("h") & old).alias("expired"), F.count_if(F.col("h") & old).alias("held_back"))


@query("catalog_health", "WITH c AS (SELECT 'documents' AS name, doc_id AS k, text IS NULL AS empty FROM documents UNION ALL SELECT 'labels', doc_id, quality IS NULL FROM labels UNION ALL SELECT 'embeddings', vec_id, embedding IS NULL FROM embeddings UNION ALL SELECT 'pages', page_id, html IS NULL FROM pages UNION ALL SELECT 'events', event_id, value IS NULL FROM events) SELECT name, count(*) AS n, count(DISTINCT k) AS keys, count(*) - count(k) AS null_keys, count(*) FILTER (WHERE empty) AS empty FROM c GROUP BY name")
def catalog_health(spark, sf_dir):
    """Each table's rows, distinct and missing keys, and rows without content."""
    part = lambda name, key, value: t(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys"), F.count_if(F.isnull(key)).alias("null_keys"), F.count_if(F.isnull(value)).alias("empty")).withColumn("name", F.lit(name))
    parts = [part(*x) for x in (("documents", "doc_id", "text"), ("labels", "doc_id", "quality"), ("embeddings", "vec_id", "embedding"), ("pages", "page_id", "html"), ("events", "event_id", "value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("record_sources", "SELECT s_nationkey, count(DISTINCT s_suppkey) AS sources, count(*) AS records, count(DISTINCT l_partkey) AS properties, max(l_shipdate) AS latest FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_nationkey")
def record_sources(spark, sf_dir):
    j = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("s_nationkey").agg(F.countDistinct("s_suppkey").alias("sources"), F.count(F.lit(1)).alias("records"), F.countDistinct("l_partkey").alias("properties"), F.max("l_shipdate").alias("latest"))


@query("record_persons", "SELECT c_custkey, c_name, count(o_orderkey) AS records, count(DISTINCT o_orderstatus) AS kinds, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_kind FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY records DESC, c_custkey LIMIT 100")
def record_persons(spark, sf_dir):
    """Persons by the number of their records, those without any too."""
    n = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("r"), F.countDistinct("o_orderstatus").alias("d"), F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_kind"))
    c = t(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    return c.select("c_custkey", "c_name", F.coalesce("r", F.lit(0)).alias("records"), F.coalesce("d", F.lit(0)).alias("kinds"), "first_kind").orderBy(F.desc("records"), "c_custkey").limit(100)


@query("record_statistics", "SELECT 'persons' AS metric, count(*) AS value FROM customer UNION ALL SELECT 'sources', count(*) FROM supplier UNION ALL SELECT 'records', count(*) FROM lineitem UNION ALL SELECT 'properties', count(*) FROM part UNION ALL SELECT 'without_records', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def record_statistics(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    return op.stats_row(persons=c, sources=t(spark, sf_dir, "supplier"), records=t(spark, sf_dir, "lineitem"), properties=t(spark, sf_dir, "part"), without_records=c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti"))


@query("validation_report", "WITH x AS (SELECT p_partkey, w AS tag, CASE WHEN p_size > 25 THEN 'pass' ELSE 'fail' END AS outcome FROM part, unnest(string_split(p_type, ' ')) u(w)) SELECT tag, count(*) AS n, count(*) FILTER (WHERE outcome = 'pass') AS passed, round(100::DOUBLE * count(*) FILTER (WHERE outcome = 'pass') / count(*), 1) AS pct, count(DISTINCT p_partkey) AS documents FROM x GROUP BY tag")
def validation_report(spark, sf_dir):
    """Outcomes by tag, of every tag that a record carries."""
    x = t(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("tag"), (F.col("p_size") > 25).alias("ok"))
    return x.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"), F.round(100.0 * F.count_if("ok") / F.count(F.lit(1)), 1).alias("pct"), F.countDistinct("p_partkey").alias("documents"))


_REASON = "CASE WHEN source IN ('src1','src2') AND regexp_matches(text, '(?i)license') THEN 'privileged:marker+domain' WHEN regexp_matches(text, '(?i)license') THEN 'privileged:marker' WHEN source IN ('src1','src2') THEN 'content:domain:' || source WHEN source IN ('src3','src4') THEN 'transactional:local_part:' || source WHEN regexp_matches(text, '!!') THEN 'spam:subject' ELSE 'content:default' END"


@query("classify_mail_reasons", f"SELECT doc_id, split_part(r, ':', 1) AS class, substring(r, length(split_part(r, ':', 1)) + 2) AS reason FROM (SELECT doc_id, {_REASON} AS r FROM documents)")
def classify_mail_reasons(spark, sf_dir, legal=("src1", "src2"), automatic=("src3", "src4"), marker="(?i)license", loud="!!"):
    """Mail classes by ordered rules, each with the reason: markers, trusted domains, automatic senders, loud subjects, and content otherwise."""
    s, x = F.col("source"), F.col("text")
    known, marked = s.isin(*legal), x.rlike(marker)
    said = lambda c, *r: F.struct(F.lit(c).alias("class"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in r]).alias("reason"))
    rule = F.when(marked & known, said("privileged", "marker+domain")).when(marked, said("privileged", "marker")).when(known, said("content", "domain:", s))
    rule = rule.when(s.isin(*automatic), said("transactional", "local_part:", s)).when(x.rlike(loud), said("spam", "subject")).otherwise(said("content", "default"))
    return t(spark, sf_dir, "documents").select("doc_id", rule.alias("r")).select("doc_id", "r.*")
