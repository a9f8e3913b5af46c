"""Operators applied to the run's tables: each query with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import dims
from tessera.functions.tables import cut
from tessera.operators import build, domains, graph, history, parse, resolve, summary, text, viz
from tessera.plans import adapters as A
from tessera.plans import samples
from tessera.plans.project import AnalyzeOptions, Project
from tessera.streaming import activity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BRANDS = "cf as (select l_orderkey sha, p_brand path from lineitem join part on l_partkey = p_partkey)"


def _pairs(cf: str) -> str:
    return f"""g as (select sha from {cf} group by sha having count(*) between 2 and 25),
d as (select distinct c.sha, c.path from {cf} c join g on c.sha = g.sha),
pairs as (select x.path a, y.path b, count(*) shared from d x join d y on x.sha = y.sha and x.path < y.path group by 1, 2)"""


_TOP = f"""{_BRANDS}, {_pairs("cf")}, c as (select path, count(*) n from cf group by 1),
top as (select a, b, shared, floor(shared / least(ca.n, cb.n) * 100 + 0.5) / 100 coupling from pairs join c ca on ca.path = a join c cb on cb.path = b
where shared >= 3 and ca.n >= 5 and cb.n >= 5 and shared / least(ca.n, cb.n) >= 0.05 order by coupling desc, shared desc, a, b limit 40)"""


def _brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.coupling(A.brand_pair_commits(spark, sf_dir), min_score=0.05)


@query(f"with {_TOP} select a, b, shared, coupling from top")
def coupling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that are ordered together more often than their own counts suggest."""
    return _brand_pairs(spark, sf_dir)


_IMPORTS = "imp as (select distinct x.p_brand source, y.p_brand target from part x join part y on y.p_partkey = x.p_partkey + 1 where x.p_size <= 5 and x.p_brand <> y.p_brand)"


def _brand_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("target"))
    return p.filter("p_size <= 5").select("p_partkey", F.col("p_brand").alias("source")).join(nxt, "p_partkey").filter("source <> target").select("source", "target").distinct()


@query(f"""with {_TOP}, {_IMPORTS}, linked as (select distinct least(source, target) a, greatest(source, target) b from imp)
select a, b, shared, coupling from top where (a, b) not in (select (a, b) from linked) order by coupling desc, shared desc, a, b limit 15""")
def coupling_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.hidden_coupling(_brand_pairs(spark, sf_dir), _brand_imports(spark, sf_dir))


@query(f"with cf as (select l_orderkey sha, l_suppkey path from lineitem), {_pairs('cf')} select a, b, shared from pairs")
def coupling_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.pair_counts(A.supplier_commits(spark, sf_dir))


@query("""select p_brand path, count(*) commits, count(distinct o_custkey) authors, sum(cast(l_quantity as bigint)) lines_changed,
min(strftime(o_orderdate, '%Y-%m-%d')) first_commit, max(strftime(o_orderdate, '%Y-%m-%d')) last_commit
from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey group by 1""")
def churn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.churn(A.order_commits(spark, sf_dir))


_TIMES = """e as (select event_type, user_id, (epoch_us(ts) // 1000) ts from events), w as (select min(ts) lo, case when max(ts) <= min(ts) then min(ts) + 86400000 else max(ts) end hi from e),
p as (select e.*, cast(greatest(0, least(47, floor((ts - lo) / (hi - lo) * 48))) as int) bucket from e, w)"""


@query(f"with {_TIMES} select cast(r.range as int) bucket, count(p.ts) n from range(48) r left join p on p.bucket = r.range group by 1")
def timeline_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.commits_per_bucket(A.event_commits(spark, sf_dir))


@query(f"""with {_TIMES}, n as (select event_type, bucket, count(*) n from p group by 1, 2),
f as (select t.event_type, r.range b, coalesce(n.n, 0) n from (select distinct event_type from e) t cross join range(48) r left join n on n.event_type = t.event_type and n.bucket = r.range)
select event_type, (select min(bucket) from n where n.event_type = f.event_type) first_bucket, string_agg(n::varchar, ',' order by b) activity from f group by 1""")
def timeline_entity_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.event_commits(spark, sf_dir)
    return history.activity(e, e, key="event_type").select("event_type", "first_bucket", F.array_join(F.transform("activity", lambda x: x.cast("string")), ",").alias("activity"))


@query(f"with {_TIMES} select user_id path, min(bucket) first_bucket from p group by 1")
def timeline_first_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.event_commits(spark, sf_dir)
    return history.activity(e, e).select("path", "first_bucket")


@query("""with s as (select l_partkey path, count(*) commits from lineitem group by 1),
f as (select path, p_size complexity, commits from s join part on p_partkey = path), m as (select max(commits) most from f),
h as (select path, floor(sqrt(greatest(0.0, least(1.0, complexity / 40.0)) * case when most <= 1 then 0.0 else greatest(0.0, least(1.0, ln(1.0::double + commits) / ln(1.0::double + most))) end) * 100 + 0.5) / 100 score, complexity, commits from f, m)
select * from h where score > 0.05 order by score desc, path limit 12""")
def hotspots_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.count(F.lit(1)).alias("commits"))
    files = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("complexity"))
    return history.hotspots(files, stats)


@query("""with i as (select l_partkey, count(*) n from lineitem where l_quantity <= 3 group by 1)
select p_partkey path, floor((0.55::double * greatest(0, least(1, p_size / 50.0::double)) + 0.45::double * greatest(0, least(1, coalesce(n, 0) / 10.0::double))) * 100 + 0.5) / 100 risk
from part left join i on l_partkey = p_partkey""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "lineitem").filter("l_quantity <= 3").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    parts = A.table(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left")
    return parts.select(F.col("p_partkey").alias("path"), summary.risk(F.col("p_size"), F.coalesce("n", F.lit(0))).alias("risk"))


_DOCS = "d as (select source || '/' || lang || '/' || doc_id || '.md' path, text content from documents)"
_LINES = """l as (select path, trim(unnest(string_split(content, chr(10))), ' ' || chr(9) || chr(13)) x from d),
m as (select path, count(*) loc, count(*) filter (x like '//%' or x like '*%' or x like '/*%') comments, count(*) filter (x = '') blank from l group by 1)"""


@query(f"with {_DOCS}, {_LINES} select path, loc, comments, blank, greatest(0, loc - comments - blank) sloc from m")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.file_metrics(A.document_files(spark, sf_dir)).drop("language")


@query(f"with {_DOCS}, {_LINES} select string_split(path, '/')[1] folder, sum(loc)::bigint loc, sum(comments)::bigint comments from m group by 1")
def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.file_metrics(A.document_files(spark, sf_dir))
    return m.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.sum("loc").alias("loc"), F.sum("comments").alias("comments"))


def _rule_rows() -> str:
    plain = [(r, c, s, p.replace("(?<=[A-Za-z0-9_])", r"\b").replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")) for g, r, c, s, _, p in dims.RULES if g in ("any", "js")]
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in plain)


_QUOTES = " or ".join(f"(len(b) - len(replace(b, '{q}', '')) - (len(b) - len(replace(b, chr(92) || '{q}', ''))) // 2) % 2 = 1" for q in ("''", '"', "`"))
_ISSUES = f"""r(rule, category, severity, pattern) as (values {_rule_rows()}),
l as (select page_id, unnest(string_split(html, chr(10))) x from pages),
h as (select page_id, rule, category, severity, x, regexp_extract(x, pattern) m, trim(x) t from l join r on regexp_matches(x, pattern)),
i as (select page_id, rule, category, severity, substr(x, 1, strpos(x, m) - 1) b from h where category in ('todo', 'smell') or not (t like '//%' or t like '*%' or t like '/*%')),
k as (select * from i where category = 'todo' or not ({_QUOTES}))"""


@query(f"with {_ISSUES} select rule, category, severity, count(*) n from k group by all")
def issues_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.issues(A.page_files(spark, sf_dir)).groupBy("rule", "category", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_ISSUES} select s.severity, count(k.rule) n from (values ('info'), ('warning'), ('error')) s(severity) left join k on k.severity = s.severity group by 1")
def issues_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_severity(text.issues(A.page_files(spark, sf_dir)))


_FOLLOW = """e as (select distinct a.l_partkey source, b.l_partkey target from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
where a.l_quantity <= 3 and a.l_partkey <> b.l_partkey)"""


@query(f"with {_FOLLOW} select target from e where source = (select max(source) from e)")
def dependencies_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = A.follow_edges(spark, sf_dir)
    return graph.dependencies_of(edges, edges.agg(F.max("source")).first()[0])


@query(f"with {_FOLLOW} select source from e where target = (select max(target) from e)")
def dependents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = A.follow_edges(spark, sf_dir)
    return graph.dependents_of(edges, edges.agg(F.max("target")).first()[0])


@query(f"with recursive {_FOLLOW}, r(node) as (select source from e where target = (select max(target) from e) union select e.source from e join r on e.target = r.node) select node from r where node <> (select max(target) from e)")
def impact_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = A.follow_edges(spark, sf_dir)
    return graph.impact_of(edges, edges.agg(F.max("target")).first()[0])


_PART_EDGES = """e as (select p_partkey source, p_partkey * p_size % (select count(*) from part) + 1 target from part where p_partkey <> p_partkey * p_size % (select count(*) from part) + 1),
r(s, t) as (select source, target from e union select r.s, e.target from r join e on r.t = e.source),
scc as (select x.s node, min(x.t) component from r x join r y on y.s = x.t and y.t = x.s group by 1)"""


@query(f"with recursive {_PART_EDGES} select component cycle_id, count(*) size, string_agg(node::varchar, ',' order by node) members from scc group by 1 having count(*) > 1")
def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.cycles(graph.strong_components(A.part_edges(spark, sf_dir)))
    return found.select("cycle_id", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(f"with recursive {_PART_EDGES} select source, target from e join scc a on a.node = source join scc b on b.node = target where a.component = b.component")
def circular_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = A.part_edges(spark, sf_dir)
    return graph.circular_edges(edges, graph.strong_components(edges))


_LINKS = "e as (select distinct url source, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) target from pages), k as (select * from e where source <> target)"


@query(f"with {_LINKS} select node, count(*) degree from (select source node from k union all select target from k) group by 1")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(A.link_edges(spark, sf_dir))


@query(f"with {_DOCS}, s as (select string_split(path, '/')[1] seg from d) select case when seg like '%.%' then 'raíz' else seg end as domain, count(*) files from s group by 1")
def domains_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.by_directory(A.document_files(spark, sf_dir)).groupBy("domain").agg(F.count(F.lit(1)).alias("files"))


@query(f"""with {_DOCS}, s as (select path, string_split(path, '/')[1] domain, string_split(path, '/')[2] parent from d),
z as (select domain, count(*) size from s group by 1), v as (select domain, parent, count(*) n, min(path) first from s group by 1, 2),
t as (select domain, arg_min(parent, (-n, first)) parent, max(n) n from v group by 1)
select z.domain, case when n >= size * 0.4 then parent else z.domain end as label, size from z join t on t.domain = z.domain""")
def domain_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.document_files(spark, sf_dir)
    return domains.labels(files.select(F.substring_index("path", "/", 1).alias("domain"), "path"))


_DOC_IMPORTS = """imp as (select a.source || '/' || a.lang || '/' || a.doc_id || '.md' source, b.source || '/' || b.lang || '/' || b.doc_id || '.md' target
from documents a join documents b on b.doc_id = a.doc_id + 1 where a.n_chars > 2000)"""


def _document_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("target"))
    return d.filter("n_chars > 2000").join(after, "doc_id").select(F.col("path").alias("source"), "target")


@query(f"""with {_DOCS}, {_LINES}, {_DOC_IMPORTS}, x as (select string_split(source, '/')[1] f, string_split(target, '/')[1] t from imp),
u as (select f, string_agg(distinct t, ',' order by t) depends_on from x where f <> t group by 1)
select string_split(path, '/')[1] as domain, count(*) files, sum(loc)::bigint loc, coalesce(any_value(depends_on), '') depends_on from m left join u on f = string_split(path, '/')[1] group by 1""")
def domain_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.document_files(spark, sf_dir)
    sizes = files.select("path", F.size(C.lines(F.col("content"))).alias("loc"))
    out = domains.detail(domains.by_directory(files), sizes, _document_imports(spark, sf_dir))
    return out.withColumn("depends_on", F.array_join("depends_on", ","))


@query(f"""with {_DOCS}, {_LINES} select path, 'markdown' as language, string_split(path, '/')[1] as domain, loc from m where string_split(path, '/')[1] = 'src0'""")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.document_files(spark, sf_dir)
    named = files.join(domains.by_directory(files), "path", "left").filter("domain = 'src0'")
    return named.select("path", "language", "domain", F.size(C.lines(F.col("content"))).alias("loc"))


@query("select url path from pages where lower(url) like '%/en/%'")
def search_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viz.search(A.table(spark, sf_dir, "pages").select(F.col("url").alias("path")), "/EN/")


# Fixed: file names and packages that give parts a source tree.
_NAMES = ["index.js", "main.py", "util.ts", "readme.md", "App.tsx", "vite.config.ts", "tsconfig.json", "manage.py"]
_PACKAGES = ["react", "@types/express", "numpy", "lodash", "next/link"]
_TREE = f"t as (select p_partkey, p_brand || '/' || p_size || '/' || ({_NAMES!r})[p_partkey % 8 + 1] path, ({_PACKAGES!r})[p_size % 5 + 1] specifier, p_size from part)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    package = F.element_at(F.array(*[F.lit(n) for n in _PACKAGES]), (F.col("p_size") % 5 + 1).cast("int"))
    t = p.select("p_partkey", "p_size", F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), name).alias("path"), package.alias("specifier"), F.lit("external").alias("kind"), F.lit(None).cast("string").alias("resolved"))
    return t.withColumn("language", C.language(F.col("path")))


@query(f"""with {_TREE}, x as (select regexp_extract(path, '\\.([a-z]+)$', 1) ext from t)
select case ext when 'js' then 'JavaScript' when 'py' then 'Python' when 'ts' then 'TypeScript' when 'md' then 'Markdown' when 'tsx' then 'TSX' else 'JSON' end as label, count(*) n from x group by 1""")
def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_language(_tree(spark, sf_dir))


@query(f"with {_TREE} select path from t where regexp_matches(path, '/(index.js|main.py|manage.py)$')")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.entry_points(_tree(spark, sf_dir))


@query(f"""with {_TREE} select 'Vite' technology from t where path like '%/vite.config.ts' union select 'TypeScript' from t where path like '%.ts' or path like '%.tsx' or path like '%/tsconfig.json'
union select 'Django' from t where path like '%/manage.py' union select 'Python' from t where path like '%.py' union select 'React' from t where specifier = 'react'
union select 'Express' from t where specifier = '@types/express' union select 'NumPy' from t where specifier = 'numpy' union select 'Next.js' from t where specifier = 'next/link'""")
def stack_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return summary.stack(t, t)


@query(f"with {_TREE} select distinct specifier from t")
def external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.external_packages(_tree(spark, sf_dir))


@query("""select (select count(*) from part) total_files, (select sum(floor(p_retailprice))::bigint from part) total_loc, (select floor(avg(p_size) * 10 + 0.5) / 10 from part) avg_complexity,
(select count(*) from lineitem) total_symbols, (select count(*) from lineitem where l_quantity <= 3) total_issues""")
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "lineitem")
    files = A.table(spark, sf_dir, "part").select(F.floor("p_retailprice").alias("loc"), F.col("p_size").alias("complexity"))
    return summary.totals(files, lines, lines.filter("l_quantity <= 3"))


@query("""with i as (select 3 cycles, (select floor(avg(p_size) * 10 + 0.5) / 10 from part) cx, (select count(*) from supplier where s_acctbal < 0) errors, (select count(*) from part where p_retailprice > 2000) big,
(select count(*) from part) documented, (select avg(p_size) from part where p_size <= 40) ratio),
f as (select -24.0 c, case when cx > 10 then floor(greatest(-20.0, -(cx - 10) * 1.5) * 10 + 0.5) / 10 else 0 end x, greatest(-25.0, -2.0 * errors) e, greatest(-15.0, -2.0 * big) b,
case when documented >= 5 and ratio < 25 then -10.0 else 0 end d from i), s as (select greatest(0, floor(100.0 + c + x + e + b + d + 0.5))::int score, (c < 0)::int + (x < 0)::int + (e < 0)::int + (b < 0)::int + (d < 0)::int n from f)
select score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 55 then 'D' else 'F' end grade, n n_factors from s""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part").agg(
        C.round_half_up(F.avg("p_size"), 1).alias("avg_complexity"),
        F.sum((F.col("p_retailprice") > 2000).cast("int")).alias("big_files"),
        F.count(F.lit(1)).alias("documented"),
        F.avg(F.when(F.col("p_size") <= 40, F.col("p_size"))).alias("doc_ratio"),
    )
    errors = A.table(spark, sf_dir, "supplier").filter("s_acctbal < 0").agg(F.count(F.lit(1)).alias("errors"))
    return summary.health(part.join(errors).withColumn("cycles", F.lit(3))).select("score", "grade", F.size("factors").alias("n_factors"))


@query(f"with {_DOCS}, {_LINES} select path id, 'file' as type, 'markdown' as language, loc from m union all select distinct 'domain:' || string_split(path, '/')[1], 'domain', null, null::bigint from m")
def slim_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _document_graph(spark, sf_dir)
    return viz.slim_nodes(nodes)


@query(f"""with {_DOCS}, {_DOC_IMPORTS} select distinct source, target, 'imports' as type from imp union all select path, 'domain:' || string_split(path, '/')[1], 'member-of' from d""")
def slim_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _document_graph(spark, sf_dir)
    return viz.slim_edges(edges).select("source", "target", "type")


def _document_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = A.document_files(spark, sf_dir)
    member = domains.by_directory(files)
    nodes = files.select(F.col("path").alias("id"), F.lit("file").alias("type"), "language", F.size(C.lines(F.col("content"))).alias("loc"))
    tops = member.select(F.concat(F.lit("domain:"), "domain").alias("id"), F.lit("domain").alias("type")).distinct()
    imports = _document_imports(spark, sf_dir).distinct().withColumn("type", F.lit("imports"))
    belongs = member.select(F.col("path").alias("source"), F.concat(F.lit("domain:"), "domain").alias("target"), F.lit("member-of").alias("type"))
    return nodes.unionByName(tops, allowMissingColumns=True), imports.unionByName(belongs)


_PICKS = "n as (select event_id, (epoch_us(ts) // 1000) moment, row_number() over (order by event_id) - 1 pos, count(*) over () - 1 last from events), k as (select distinct floor(r.range * last / 19.0 + 0.5)::bigint pos from range(20) r, (select distinct last from n)), p as (select n.* from n join k on k.pos = n.pos)"


@query(f"with {_PICKS} select event_id, moment from p")
def pick_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = A.table(spark, sf_dir, "events").select("event_id", A.millis("ts").alias("moment"))
    return history.pick_evenly(items, "event_id", 20)


@query(f"with {_PICKS}, c as (select e.event_id, abs(p.moment - (epoch_us(e.ts) // 1000)) gap, p.event_id point from events e, p) select event_id, min(gap) gap, arg_min(point, (gap, point)) point from c group by 1")
def nearest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = A.table(spark, sf_dir, "events").select("event_id", A.millis("ts").alias("ts"))
    points = pick_evenly(spark, sf_dir).select(F.col("event_id").alias("pos"), F.col("moment").alias("at"))
    return history.nearest(points, moments, "at", "ts", "pos").select("event_id", "gap", F.col("nearest_pos").alias("point"))


@query("""with s as (select n_regionkey rank, n_nationkey pos, n_name, ceil(length(repeat(n_name || ' ', n_nationkey + 1)) / 3.7) + 2 cost from nation),
r as (select *, 18 + sum(cost) over (order by rank, pos) used, row_number() over (order by rank, pos) i from s), f as (select coalesce(min(i), 1000000) i from r where used > 300 and i > 1)
select r.rank, r.pos, r.n_name as name from r, f where r.i < f.i""")
def codemap_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "nation")
    sections = n.select(F.col("n_regionkey").alias("rank"), F.col("n_nationkey").alias("pos"), F.expr("repeat(concat(n_name, ' '), n_nationkey + 1)").alias("text"), F.col("n_name").alias("name"))
    return viz.within_budget(sections, 300, 18).select("rank", "pos", "name")


def _sample(spark: SparkSession) -> Project:
    return Project(spark, samples.frame(spark), AnalyzeOptions("demo", samples.CONFIG)).analyze()


def _symbols(files: DataFrame) -> DataFrame:
    return parse.parse(files).select("path", "complexity", "doc_coverage", F.size("imports").alias("n_imports"), F.explode_outer("symbols").alias("s")).select("path", "complexity", "doc_coverage", "n_imports", "s.name", "s.kind", "s.line", "s.end_line", "s.exported", "s.documented")


def _parsed(spark: SparkSession, languages: list[str]) -> DataFrame:
    return _symbols(text.admit(samples.frame(spark)).filter(F.col("language").isin(languages)))


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.admit(A.part_code(spark, sf_dir))


def _part_imports(parsed: DataFrame, files: DataFrame) -> DataFrame:
    found = parsed.select("path", F.posexplode("imports").alias("pos", "i")).select("path", "pos", "i.specifier", "i.kind", "i.line")
    return resolve.resolve_imports(found, files.select("path"))


def _part_symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("symbols").alias("pos", "s")).select("path", "pos", "s.id", "s.name", "s.kind", "s.exported", "s.calls")


# What the files made of parts say, in SQL: k is a file's own number, n that of the file that it imports and calls.
_CODE = """code as (select k, n, s, even, odd, case when odd then concat('py/m', k, '.py') else concat('web/m', k, '.js') end path, case when odd then concat('py/m', n, '.py') else concat('web/m', n, '.js') end next_path
from (select p_partkey k, case when p_partkey + 2 <= (select max(p_partkey) from part) then p_partkey + 2 else p_partkey % 2 end n, p_size s, p_size % 2 = 0 even, p_partkey % 2 = 1 odd from part)),
own as (select path, concat(path, '#', case when odd then 'g' else 'f' end, k) id, concat(next_path, '#', case when odd then 'g' else 'f' end, n) callee, next_path, odd, k, n from code),
said as (select path, case when odd then concat('.m', n) else concat('./m', n) end specifier, 'internal' kind, next_path resolved from own
union all select path, case when odd then 'os' else concat('tool', k % 7) end, 'external', null from own)"""


@query(f"with {_CODE} select path, 3 complexity, case when even then 100 else 0 end doc_coverage, 2 n_imports, concat('g', k) as name, 'function' kind, 5 line, case when even then 9 else 8 end end_line, true exported, even documented from code where odd")
def parse_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(_part_files(spark, sf_dir).filter("language = 'python'"))


@query(f"with {_CODE} select path, 2 complexity, case when even then 100 else 0 end doc_coverage, 2 n_imports, concat('f', k) as name, 'function' kind, case when even then 4 else 3 end line, case when even then 9 else 8 end end_line, true exported, even documented from code where not odd")
def parse_javascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(_part_files(spark, sf_dir).filter(F.col("language").isin(dims.JS_LIKE)))


@query()
def parse_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, ["go", "rust", "java"])


@query(f"with {_CODE} select path, specifier, kind, resolved from said")
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _part_files(spark, sf_dir)
    return _part_imports(parse.parse(files), files).select("path", "specifier", "kind", "resolved")


@query(f"with {_CODE} select id source, callee target from own where id <> callee")
def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_calls(_part_symbols(cut(parse.parse(_part_files(spark, sf_dir)).select("path", "symbols"))))


@query(f"""with {_CODE}, e as (select path source, split_part(path, '/', 1) target, 'member-of' as type from own union all select path, id, 'contains' from own union all select id, callee, 'calls' from own
union all select path, coalesce(resolved, concat('ext:', specifier)), 'imports' from said)
select distinct concat(type, ':', source, '→', target) id, source, target, type from e where source <> target""")
def part_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations of the files made of parts, with their folders as domains."""
    return _part_graph(spark, sf_dir)[1].select("id", "source", "target", "type")


@query(f"""with {_CODE} select path id, 'file' as type, parse_filename(path) label, path, case when odd then 'python' else 'javascript' end as language, case when odd then 3 else 2 end complexity, split_part(path, '/', 1) as domain, null kind, null file, null::boolean exported from own
union all select id, 'symbol', split_part(id, '#', 2), null, null, null, null, 'function', path, true from own union all select split_part(path, '/', 1), 'domain', split_part(path, '/', 1), null, null, null, null, null, null, null from own group by 1
union all select concat('ext:', specifier), 'external', specifier, null, null, null, null, null, null, null from said where resolved is null group by specifier""")
def part_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of that graph, with the symbol plane at any size."""
    return _part_graph(spark, sf_dir)[0].select("id", "type", "label", "path", "language", "complexity", "domain", "kind", "file", "exported")


def _part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parsed = cut(parse.parse(_part_files(spark, sf_dir)).select("path", "language", "complexity", "imports", "symbols"))  # parsed once for all planes
    files = parsed.select("path", "language", F.lit(0).alias("loc"), "complexity", F.lit(0).alias("issues"))
    members = domains.by_directory(files)
    named = members.groupBy(F.col("domain").alias("id")).agg(F.count(F.lit(1)).alias("size")).select("id", F.col("id").alias("label"), "size", F.lit("").alias("color"))
    none = spark.createDataFrame([], "source string, target string")
    return build.build(files, _part_symbols(parsed), _part_imports(parsed, parsed), members, named, none, max_symbols=None)


@query()
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).nodes


@query()
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).edges


@query()
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).find_symbol("SUM")


@query()
def describe_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).describe_file("web/math.js").select("path", "loc", "complexity", "imports", "imported_by")


@query()
def codemap_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_sample(spark).overview("full"),)], "markdown string")


@query()
def louvain_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the documents' links, a project for each language."""
    d = A.document_files(spark, sf_dir).select(F.element_at(F.split("path", "/"), 2).alias("project"), "path")
    imports = _document_imports(spark, sf_dir).withColumn("project", F.element_at(F.split("source", "/"), 2))
    return domains.by_imports(d, imports)


@query("select event_type, time_bucket(interval '1 hour', ts) hour_start, count(*) n from events group by 1, 2")
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming activity counts, run over the whole table as one stream."""
    return activity.run_once(spark, f"{sf_dir}/events.parquet", "ts", "event_type").select("event_type", F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "n")
