"""Queries on scopes, execution targets, routes, conflicts, references and version contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as R
from .registry import query, table
from .repair_queries import OUTCOMES, VARIABLES, outcomes, pick, variables


@query("scope_dimensions", """WITH x AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['', NULL] WHEN p_size % 3 = 0 THEN ['a', '', 'b'] ELSE ['c'] END AS s, CASE WHEN p_size % 5 = 0 THEN [] WHEN p_size % 7 <> 0 THEN [p_brand] END AS t FROM part),
 y AS (SELECT p_partkey, list_filter(s, lambda v: v <> '') AS s, list_filter(t, lambda v: v <> '') AS t FROM x) SELECT p_partkey, CASE WHEN len(s) > 0 THEN array_to_string(s, ',') ELSE '' END AS state, coalesce(array_to_string(t, ','), '') AS brand, (CASE WHEN len(s) > 0 THEN 1 ELSE 0 END + CASE WHEN len(t) > 0 AND p_partkey % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS newly FROM y""")
def scope_dimensions(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    text = lambda *v: F.array(*[F.lit(x).cast("string") for x in v])
    state = F.when(s % 2 == 0, text("", None)).when(s % 3 == 0, text("a", "", "b")).otherwise(text("c"))
    brand = F.when(s % 5 == 0, F.array().cast("array<string>")).when(s % 7 != 0, F.array("p_brand"))
    after = F.create_map(F.lit(" state "), state, F.lit("brand"), brand, F.lit(" "), text("x"))
    before = F.create_map(F.lit("brand"), F.when(k % 2 == 1, text("old")))
    x = table(spark, sf_dir, "part").select("p_partkey", R.populated_scope(after).alias("m"), R.newly_populated(before, after).alias("newly"))
    of = lambda d: F.coalesce(F.array_join(F.try_element_at("m", F.lit(d)), ","), F.lit(""))
    return x.select("p_partkey", of("state").alias("state"), of("brand").alias("brand"), "newly")


@query("scope_shape", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'scope dimension state must be list-valued' WHEN 2 THEN 'scope must be an object whose values are lists' ELSE 'scope contains an empty dimension name|scope dimension b must be list-valued' END AS issues FROM orders""")
def scope_shape(spark, sf_dir):
    raw = pick(['{"state": ["a"]}', '{"state": "a"}', '["state"]', '{" ": [1], "b": 3, "c": []}'], F.col("o_orderkey") % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(R.scope_issues(raw), "|").alias("issues"))


@query("execution_targets", "WITH " + VARIABLES + """, g AS (SELECT rule_id, count(*) FILTER (WHERE role = 'input') AS i, count(*) FILTER (WHERE role = 'output') AS o FROM v GROUP BY rule_id)
 SELECT p_partkey AS rule_id, concat_ws(',', CASE WHEN o > 0 AND (i > 0 OR p_size % 2 = 0) THEN 'DMN' END, CASE WHEN p_size % 3 = 0 THEN 'BPMN' END) AS targets FROM part JOIN g ON rule_id = p_partkey""")
def execution_targets(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") % 2 == 0).alias("unconditional"), (F.col("p_size") % 3 == 0).alias("bpmn_eligible"))
    return R.execution_targets(rules, variables(spark, sf_dir)).select("rule_id", F.array_join("targets", ",").alias("targets"))


STEP = "struct<step_id:string,name:string,kind:string>"


@query("bpmn_eligibility", """WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE turn % 3 = 2) AS odd, list(turn ORDER BY turn) AS ts FROM conversations GROUP BY conv_id)
 SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'workflow_semantics is absent' ELSE concat_ws('; ', CASE WHEN conv_id % 3 = 0 THEN 'workflow kind is not prescriptive_process' END, CASE WHEN conv_id % 5 = 0 THEN 'trigger_event is absent' END, CASE WHEN conv_id % 4 = 0 THEN 'actor_role does not match responsible_party' END,
  CASE conv_id % 7 WHEN 0 THEN 'workflow evidence is absent' WHEN 1 THEN 'workflow evidence 1 is incomplete' END, CASE WHEN n < 2 THEN 'at least two explicit ordered_steps are required' ELSE nullif(array_to_string(list_transform(list_filter(range(0, n), lambda i: ts[i + 1] % 3 = 2), lambda i: 'ordered_steps[' || i || '] has an unsupported kind'), '; '), '') END) END AS reasons FROM c""")
def bpmn_eligibility(spark, sf_dir):
    """Conversations as workflows, their turns as steps."""
    k, turn = F.col("conv_id"), F.col("turn")
    step = F.struct(turn, F.concat(F.lit("s"), turn.cast("string")).alias("step_id"), F.coalesce("role", F.lit("x")).alias("name"), F.when(turn % 3 != 2, "user_task").otherwise("odd").alias("kind"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
    proof = lambda t: F.struct(F.lit("a/b").alias("chunk_path"), F.lit("s1").alias("section_id"), F.lit(t).alias("source_text"))
    evidence = F.when(k % 7 == 0, F.array().cast("array<struct<chunk_path:string,section_id:string,source_text:string>>")).when(k % 7 == 1, F.array(proof("t"), proof(" "))).otherwise(F.array(proof("t")))
    w = F.struct(
        F.when(k % 3 == 0, "narrative").otherwise("prescriptive_process").alias("kind"), F.lit("explicit_in_source").alias("basis"), F.when(k % 5 != 0, "on receipt").alias("trigger_event"), F.when(k % 4 == 0, "CLERK").otherwise("LENDER").alias("actor_role"),
        evidence.alias("evidence"), F.col("s").cast(f"array<struct<turn:bigint,{STEP[7:]}>").alias("ordered_steps"),
    )
    return c.select("conv_id", F.array_join(R.bpmn_reasons(F.when(k % 11 != 0, w), F.lit("LENDER ")), "; ").alias("reasons"))


CLAIM_TYPES = ["condition", "scope", "description", "workflow_actor", "workflow_step", "case_task", "concept", "variable", "classification", "odd", ""]


@query("claim_requirements", """WITH x AS (SELECT event_id, ['condition', 'scope', 'description', 'workflow_actor', 'workflow_step', 'case_task', 'concept', 'variable', 'classification', 'odd', ''][event_id % 11 + 1] AS t, ['a', 'counterparties[0]', 'responsible_party', ' '][event_id % 4 + 1] AS p FROM events),
 r AS (SELECT *, CASE WHEN trim(p) = '' OR t = '' THEN 'unknown:bpmn,cmmn,dmn,lexec,sbvr' WHEN t = 'description' THEN 'presentation:' WHEN p LIKE 'counterparties[%' THEN 'source_bearing:bpmn,cmmn' WHEN t IN ('condition', 'scope') THEN 'source_bearing:dmn,lexec' WHEN p = 'responsible_party' OR t = 'workflow_actor' THEN 'source_bearing:bpmn,cmmn'
  WHEN t = 'workflow_step' THEN 'source_bearing:bpmn' WHEN t = 'case_task' THEN 'source_bearing:cmmn' WHEN t = 'concept' THEN 'source_bearing:sbvr' WHEN t = 'variable' THEN 'derived:dmn,lexec' WHEN t = 'classification' THEN 'derived:' ELSE 'unknown:bpmn,cmmn,dmn,lexec,sbvr' END AS q FROM x)
 SELECT event_id, split_part(q, ':', 1) AS origin, split_part(q, ':', 2) AS required_for FROM r""")
def claim_requirements(spark, sf_dir):
    k = F.col("event_id")
    x = table(spark, sf_dir, "events").select("event_id", R.claim_requirement(pick(["a", "counterparties[0]", "responsible_party", " "], k % 4), pick(CLAIM_TYPES, k % 11)).alias("r"))
    return x.select("event_id", "r.origin", F.array_join("r.required_for", ",").alias("required_for"))


@query("rule_modality", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'prohibition' WHEN o_orderpriority = '3-MEDIUM' THEN 'definition' WHEN o_orderkey % 3 = 0 THEN 'obligation' WHEN o_orderkey % 3 = 1 THEN 'permission' ELSE 'none' END AS modality FROM orders")
def rule_modality(spark, sf_dir):
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    kind = F.when(p == "1-URGENT", "Loan Restriction").when(p == "2-HIGH", "prohibited use").when(p == "3-MEDIUM", " Definition ").otherwise(p)
    return table(spark, sf_dir, "orders").select("o_orderkey", R.modality(kind, F.when(k % 3 < 2, k % 3 == 0)).alias("modality"))


@query("finding_routes", """WITH f AS (SELECT user_id AS rule_id, ['grounding', 'contract', 'naming', NULL][event_id % 4 + 1] AS requirement, ['missing_evidence', 'bad_code', NULL][event_id % 3 + 1] AS code, CASE WHEN event_id % 50 = 7 THEN 'A Source Conflict here' ELSE (event_id % 40 // 39) || ' contradicted and 3 insufficient' END AS reason, event_id % 9 = 0 AS lim FROM events WHERE event_type = 'error'),
 g AS (SELECT *, CASE WHEN requirement = 'grounding' AND reason LIKE '% contradicted%' THEN reason LIKE '1 %' ELSE reason LIKE 'A %' END AS h, coalesce(requirement, CASE WHEN code IS NULL THEN 'unclassified' WHEN code LIKE '%evidence%' THEN 'evidence' ELSE 'contract' END) AS need FROM f)
 SELECT rule_id, CASE WHEN bool_or(h) THEN 'human_review' WHEN bool_and(need IN ('contract', 'naming') AND NOT lim) THEN 'machine_repair' ELSE 'case_management' END AS route, bool_or(h) AS human_review_required FROM g GROUP BY rule_id""")
def finding_routes(spark, sf_dir):
    k = F.col("event_id")
    f = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("user_id").alias("rule_id"), pick(["grounding", "contract", "naming", None], k % 4).alias("requirement"), pick(["missing_evidence", "bad_code", None], k % 3).alias("code"),
        F.when(k % 50 == 7, "A Source Conflict here").otherwise(F.concat(F.floor(k % 40 / 39).cast("string"), F.lit(" contradicted and 3 insufficient"))).alias("reason"), F.lit(None).cast("boolean").alias("human_review_required"), (k % 9 == 0).alias("evidence_limited"),
    )
    return R.review_routes(f)


@query("failure_routes", """SELECT event_id, array_to_string(list_sort(list_distinct(list_filter([['scope', ' '][event_id % 2 + 1] , CASE event_id % 4 WHEN 0 THEN 'code:no_exception' WHEN 1 THEN 'code:bad_scope' WHEN 2 THEN 'code:odd' END, CASE event_id % 4 WHEN 0 THEN 'exceptions' WHEN 1 THEN 'scope' WHEN 2 THEN 'contract' END], lambda x: trim(x) <> ''))), ',') AS routes FROM events""")
def failure_routes(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(R.failure_routes(pick(["scope", " "], k % 2), pick(["no_exception", "bad_scope", "odd", None], k % 4)), ",").alias("routes"))


@query("source_roots", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'a' WHEN 2 THEN 'pkg' END AS root FROM documents""")
def source_roots(spark, sf_dir):
    k = F.col("doc_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("/"), "source", F.lit("/x.txt"))).when(k % 4 == 1, "./a/../b").when(k % 4 == 2, "\\pkg\\f.txt").otherwise("./..")
    return table(spark, sf_dir, "documents").select("doc_id", R.source_root(path).alias("root"))


@query("entity_rule_groups", """WITH x AS (SELECT p_partkey, unnest([p_brand, lower(p_type) || ' ', CASE WHEN p_size % 2 = 0 THEN p_type END]) AS e FROM part), k AS (SELECT DISTINCT p_partkey, upper(trim(regexp_replace(e, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS entity FROM x WHERE trim(e) <> '') SELECT entity, count(*) AS rules FROM k GROUP BY entity""")
def entity_rule_groups(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("a"), F.concat(F.lower("p_type"), F.lit(" ")).alias("b"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("c"))
    return R.entity_groups(rules, ["a", "b", "c"]).groupBy("entity").agg(F.count("*").alias("rules"))


@query("conflict_groups", """WITH g AS (SELECT DISTINCT p_partkey AS rule_id, upper(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')) AS entity FROM part), c AS (SELECT DISTINCT l_partkey AS rule_id, 'site_' || l_suppkey % 5 AS root FROM lineitem WHERE l_partkey % 3 > 0),
 x AS (SELECT entity, coalesce(root, '__unscoped__') AS root, rule_id FROM g LEFT JOIN c USING (rule_id)) SELECT entity, root, count(DISTINCT rule_id) AS rules FROM x GROUP BY ALL HAVING count(DISTINCT rule_id) > 1""")
def conflict_groups(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("a"))
    cites = table(spark, sf_dir, "lineitem").where("l_partkey % 3 > 0").select(F.col("l_partkey").alias("rule_id"), F.concat(F.lit("site_"), (F.col("l_suppkey") % 5).cast("string"), F.lit("/f.txt")).alias("chunk_path"))
    return R.conflict_groups(R.entity_groups(rules, ["a"]), cites)


#: Groups of up to four neighbouring rules whose conflict is open.
ENTRIES = """e AS (SELECT p_partkey // 4 AS entity, list(p_partkey ORDER BY p_partkey) AS ids, CASE p_partkey // 4 % 3 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'conflict' ELSE 'non_conflict' END AS status, CASE WHEN p_partkey // 4 % 2 = 0 THEN 'kept' END AS resolution FROM part GROUP BY ALL),
 oc AS (SELECT p_partkey AS id, ['decision', 'rate'][p_size % 2 + 1] AS variable, ['true', 'Eligible', 'not_eligible', 'false'][p_size % 4 + 1] AS value, ['boolean', 'enum', 'enum', 'boolean'][p_size % 4 + 1] AS kind FROM part),
 ov AS (SELECT id, variable, CASE WHEN value IN ('true', 'Eligible') THEN 'y' ELSE 'n' END AS v FROM oc),
 pr AS (SELECT entity, x AS a, y AS b FROM (SELECT entity, unnest(ids) AS x, ids FROM e WHERE status = 'unresolved' OR (status = 'conflict' AND resolution IS NULL)) t, unnest(ids) u(y) WHERE x < y),
 cp AS (SELECT entity, a, b, CASE WHEN bool_or(p.v <> q.v) THEN 'unresolved' ELSE 'non_conflict' END AS status FROM pr LEFT JOIN ov p ON p.id = a LEFT JOIN ov q ON q.id = b AND q.variable = p.variable GROUP BY ALL)"""


def entries(spark, sf_dir):
    k, s, g = F.col("p_partkey"), F.col("p_size"), F.floor(F.col("p_partkey") / 4)
    p = table(spark, sf_dir, "part")
    e = p.groupBy(g.alias("entity")).agg(F.collect_list("p_partkey").alias("rule_ids")).select("entity", "rule_ids", pick(["unresolved", "conflict", "non_conflict"], F.col("entity") % 3).alias("status"), F.when(F.col("entity") % 2 == 0, "kept").alias("resolution"))
    return e, p.select(k.alias("rule_id"), pick(["decision", "rate"], s % 2).alias("variable"), pick(["true", "Eligible", "not_eligible", "false"], s % 4).alias("value"), pick(["boolean", "enum", "enum", "boolean"], s % 4).alias("value_type"))


@query("conflict_pairs", "WITH " + ENTRIES + " SELECT * FROM cp")
def conflict_pairs(spark, sf_dir):
    return R.conflict_pairs(*entries(spark, sf_dir))


@query("conflict_candidates_open", "WITH " + ENTRIES + " SELECT * FROM cp WHERE status = 'unresolved' ORDER BY entity, a, b LIMIT 5000")
def conflict_candidates_open(spark, sf_dir):
    """One remediation request: so many open pairs, in order."""
    return R.conflict_pairs(*entries(spark, sf_dir), most=R.MOST_CANDIDATES)


@query("conflict_dedup", "SELECT sha256(coalesce(lang, chr(0)) || chr(31) || coalesce(source, chr(0))) AS conflict_id, lang, source, count(*) AS copies FROM documents GROUP BY lang, source")
def conflict_dedup(spark, sf_dir):
    return R.dedup_conflicts(table(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"])


@query("orphan_buckets", "SELECT c_custkey, c_mktsegment AS bucket FROM customer WHERE upper(c_mktsegment) NOT IN ('BUILDING', 'MACHINERY')")
def orphan_buckets(spark, sf_dir):
    known = spark.createDataFrame([("Building",), ("machinery ",)], "name string")
    return R.missing_keys(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("bucket")), known, "bucket")


@query("party_placeholders", "SELECT 'BUILDING' AS name, 'a' AS definition, false AS placeholder UNION ALL SELECT 'MACHINERY', 'b', false UNION ALL SELECT DISTINCT upper(c_mktsegment), NULL, true FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def party_placeholders(spark, sf_dir):
    catalog = spark.createDataFrame([("BUILDING", "a"), ("MACHINERY", "b")], "name string, definition string")
    return R.placeholders(table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("party")), catalog)


@query("naming_issues", "WITH k AS (SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_custkey % 2 = 0 AND regexp_full_match(c_mktsegment, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*')), r AS (SELECT 'C' || c_custkey AS rule_id, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS value FROM customer) SELECT rule_id || '.responsible_party' AS path, value FROM r WHERE value NOT IN (SELECT name FROM k)")
def naming_issues(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    refs = c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("rule_id"), F.lit("responsible_party").alias("field"), F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("value"))
    return R.naming_issues(refs, c.where("c_custkey % 2 = 0").select(F.col("c_mktsegment").alias("name")))


@query("run_status", "SELECT user_id AS run, CASE WHEN bool_or(event_type = 'error') THEN 'fail' WHEN bool_or(event_type = 'signup') THEN 'review' WHEN bool_or(event_type = 'click') THEN 'pass' ELSE 'fail' END AS status FROM events GROUP BY user_id")
def run_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "review").when(F.col("event_type") == "click", "pass").alias("status"))
    return R.run_status(e, "run")


@query("stage_gates", "SELECT user_id AS run, count(*) FILTER (WHERE event_type = 'error') = 0 AND count(*) FILTER (WHERE event_type <> 'click') > 0 AS review_only, count(*) FILTER (WHERE event_type = 'error') > 0 OR count(*) FILTER (WHERE event_type <> 'click') > 0 AS remediate, count(*) FILTER (WHERE value > 400) = 0 AS grounding_complete FROM events GROUP BY user_id")
def stage_gates(spark, sf_dir):
    t = F.col("event_type")
    return R.gates(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("total"), F.count_if(t == "click").alias("ready"), F.count_if(t == "error").alias("failed_invariants"), F.count_if(F.col("value") > 400).alias("unverified")))


@query("fixture_consistency", "WITH x AS (SELECT o_orderkey AS id, o_orderkey % 10 <> 3 AS r, o_orderkey % 10 = 3 AND o_orderkey % 6 <> 0 AS c FROM orders) SELECT 'rules' AS side, id FROM x WHERE r UNION ALL SELECT 'cases', id FROM x WHERE c UNION ALL SELECT 'edges', id FROM x")
def fixture_consistency(spark, sf_dir):
    """Ids of rules, cases and edges that are not in all three."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return R.set_differences({"rules": o.where("id % 10 <> 3"), "cases": o.where("id % 10 = 3 and id % 6 <> 0"), "edges": o}, "id")


@query("rule_statements", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand ELSE 'When ' || CASE WHEN p_partkey % 2 = 0 THEN 'size == ' || p_size ELSE 'the rule applies' END || ', then the policy outcome is evaluated.' END AS statement, CASE WHEN p_size % 4 = 0 THEN p_type ELSE 'Uncategorized' END AS category FROM part""")
def rule_statements(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    st = R.statement([F.when(s % 3 == 0, F.col("p_name")).otherwise(" "), F.when(s % 3 == 1, F.col("p_brand"))], F.when(k % 2 == 0, F.concat(F.lit("size == "), s.cast("string"))), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", st.alias("statement"), R.first_present(F.lit(None).cast("string"), F.when(s % 4 == 0, F.col("p_type")), F.lit("Uncategorized")).alias("category"))


REFS = """r AS (SELECT l_orderkey % 500 AS rule_id, l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS field, CASE WHEN l_partkey % 9 > 0 THEN 'site_' || l_suppkey % 3 END AS path, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 's' || l_partkey % 4 END AS section, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS s FROM lineitem)"""


def references(spark, sf_dir):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("rule_id"), (F.col("l_orderkey") * 10 + n).alias("pos"), F.col("l_returnflag").alias("field"), F.when(p % 9 > 0, F.concat(F.lit("site_"), (F.col("l_suppkey") % 3).cast("string"))).alias("chunk_path"),
        F.when(p % 4 == 0, "").otherwise(F.concat(F.lit("s"), (p % 4).cast("string"))).alias("section_id"), F.when(n % 2 == 0, n).alias("start"), F.lit(None).cast("int").alias("end"),
    )


@query("reference_anchors", "WITH " + REFS + ", a AS (SELECT *, 'source-' || left(sha1(coalesce(path, '') || '|' || section || '|' || coalesce(s::VARCHAR, '') || '|'), 16) AS anchor FROM r) SELECT rule_id, anchor, min(struct_pack(p := pos, f := field)).f AS field, min(pos) AS pos, count(*) AS uses FROM a GROUP BY rule_id, anchor")
def reference_anchors(spark, sf_dir):
    return R.unique_references(references(spark, sf_dir))


@query("cited_passages", "WITH " + REFS + " SELECT path AS chunk_path, section AS section_id, count(DISTINCT rule_id) AS rules FROM r WHERE path IS NOT NULL AND section <> '' GROUP BY ALL")
def cited_passages(spark, sf_dir):
    return R.passages(references(spark, sf_dir)).groupBy("chunk_path", "section_id").agg(F.count("*").alias("rules"))


@query("section_manifest", "WITH " + REFS + """, b AS (SELECT DISTINCT path || ':' || section AS section_id FROM r WHERE rule_id % 2 = 0 AND path IS NOT NULL AND section <> 's1'), a AS (SELECT DISTINCT path || ':' || section AS section_id FROM r WHERE rule_id % 2 = 1 AND path IS NOT NULL AND section <> 's2'),
 m AS (SELECT section_id, 'added' AS change FROM a WHERE section_id NOT IN (SELECT section_id FROM b) UNION ALL SELECT section_id, 'removed' FROM b WHERE section_id NOT IN (SELECT section_id FROM a)) SELECT section_id, change, CASE WHEN section_id = 'site_1:s1' THEN 'new source' ELSE '' END AS reason, section_id = 'site_1:s1' AS pass FROM m""")
def section_manifest(spark, sf_dir):
    x = references(spark, sf_dir).where("chunk_path is not null").withColumn("section_id", F.concat("chunk_path", F.lit(":"), "section_id"))
    return R.section_manifest(x.where("rule_id % 2 = 0 and section_id not like '%:s1'"), x.where("rule_id % 2 = 1 and section_id not like '%:s2'"), spark.createDataFrame([("site_1:s1", "new source")], "section_id string, reason string"))


@query("reference_texts", "WITH " + REFS + """, c AS (SELECT 'site_' || k % 3 AS path, CASE WHEN k < 3 THEN '' ELSE 's' || k % 4 END AS section, 'text ' || k AS t FROM range(12) g(k)), u AS (SELECT path, section, min(t) AS t FROM c GROUP BY ALL) SELECT r.rule_id, r.pos, coalesce(CASE WHEN r.s = 4 THEN 'own' END, x.t, w.t, '') AS shown FROM r LEFT JOIN u x ON x.path = r.path AND x.section = r.section LEFT JOIN u w ON w.path = r.path AND w.section = ''""")
def reference_texts(spark, sf_dir):
    k = F.col("id")
    c = spark.range(12).select(F.concat(F.lit("site_"), (k % 3).cast("string")).alias("chunk_path"), F.when(k >= 3, F.concat(F.lit("s"), (k % 4).cast("string"))).alias("section_id"), F.concat(F.lit("text "), k.cast("string")).alias("text"))
    c = c.groupBy("chunk_path", "section_id").agg(F.min("text").alias("text"))
    return R.reference_texts(references(spark, sf_dir).withColumn("source_text", F.when(F.col("start") == 4, "own")), c).select("rule_id", "pos", "shown")


EDGE = """e AS (SELECT o_orderkey AS source, o_custkey AS target, ['dataflow', 'Association ', 'gating'][o_orderkey % 3 + 1] AS kind, CASE WHEN o_orderkey % 5 = 0 THEN false WHEN o_orderkey % 5 = 1 THEN true END AS directed, o_orderkey % 7 <> 0 AS canonical, o_orderkey % 11 <> 0 AS verified FROM orders)"""


def raw_edges(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("source"), F.col("o_custkey").alias("target"), pick(["dataflow", "Association ", "gating"], k % 3).alias("kind"), F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("directed"), F.when(k % 7 != 0, "canonical").otherwise("rejected").alias("admission"), (k % 11 != 0).alias("verified"))


@query("canonical_edges", "WITH " + EDGE + " SELECT source, target, 'admitted' AS mode FROM e WHERE coalesce(directed, true) AND kind <> 'Association ' AND canonical AND verified UNION ALL SELECT source, target, 'open' FROM e WHERE coalesce(directed, true) AND kind <> 'Association ' UNION ALL SELECT o_custkey, o_orderkey, 'lists' FROM orders")
def canonical_edges(spark, sf_dir):
    e, lists = raw_edges(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"))
    mode = lambda df, m: df.withColumn("mode", F.lit(m))
    return mode(R.canonical_edges(e, lists, True), "admitted").unionByName(mode(R.canonical_edges(e, lists, False), "open")).unionByName(mode(R.canonical_edges(e.where("kind = 'Association '"), lists, False), "lists"))


@query("union_edges", """WITH a AS (SELECT o_orderkey AS new_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey + 1000000 END AS old_id FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS s, o_orderkey // 2 AS t FROM orders), t AS (SELECT coalesce(x.old_id, s) AS source, coalesce(y.old_id, t) AS target FROM n LEFT JOIN a x ON x.new_id = s LEFT JOIN a y ON y.new_id = t)
 SELECT source, target FROM t UNION SELECT o_orderkey + 1000000, o_orderkey FROM orders WHERE o_orderkey % 3 = 0""")
def union_edges(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    aligned = o.where("o_orderkey % 2 = 0").select(F.when(k % 4 > 0, k + 1000000).alias("old_id"), k.alias("new_id"))
    return R.union_edges(o.where("o_orderkey % 3 = 0").select((k + 1000000).alias("source"), k.alias("target")), o.select(k.alias("source"), F.floor(k / 2).alias("target")), aligned)


@query("semantic_pairs", "SELECT x.p_partkey AS old_id, y.p_partkey AS new_id FROM part x JOIN part y ON lower(x.p_brand) = lower(y.p_brand) WHERE x.p_partkey % 3 <> 0 AND x.p_partkey < 100 AND y.p_partkey % 4 = 1 AND y.p_partkey % 3 <> 0 AND y.p_partkey < 100 ORDER BY 1, 2 LIMIT 10000")
def semantic_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey < 100").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("rule_type"))
    aligned = p.where("rule_id % 3 = 0").select(F.col("rule_id").alias("old_id"), F.col("rule_id").alias("new_id"))
    return R.semantic_pairs(p, p.where("rule_id % 4 = 1").withColumn("rule_type", F.upper("rule_type")), aligned, 10000)


@query("response_protocol", """WITH c AS (SELECT DISTINCT user_id AS rule_id, event_type AS claim_id FROM events WHERE event_id % 3 > 0), r AS (SELECT user_id AS rule_id, event_type AS claim_id, count(*) AS n FROM events WHERE event_id % 5 = 0 GROUP BY ALL), x AS (SELECT coalesce(c.rule_id, r.rule_id) AS rule_id, c.rule_id IS NOT NULL AS asked, coalesce(n, 0) AS n FROM c FULL JOIN r ON c.rule_id = r.rule_id AND c.claim_id = r.claim_id)
 SELECT rule_id, count(*) FILTER (WHERE asked AND n > 0) AS returned, count(*) FILTER (WHERE asked AND n = 0) AS missing, coalesce(sum(n - 1) FILTER (WHERE asked AND n > 1), 0)::BIGINT AS duplicates, coalesce(sum(n) FILTER (WHERE NOT asked), 0)::BIGINT AS unexpected FROM x GROUP BY rule_id""")
def response_protocol(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("rule_id"), F.col("event_type").alias("claim_id"))
    return R.response_protocol(e.where("event_id % 3 > 0"), e.where("event_id % 5 = 0"))


@query("negative_provenance", "SELECT o_orderkey, o_orderkey % 3 < 2 AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 2 = 0 AS certified FROM orders")
def negative_provenance(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, "explicitly_none_in_source").when(k % 3 == 1, "genuinely_unscoped").otherwise("explicit")
    search = F.struct(F.when(k % 5 > 0, said).alias("status"), F.when(k % 7 > 0, "abc").alias("corpus_sha256"), (k % 2).alias("chunk_count"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.negative_provenance(F.when(k % 3 == 0, "exception_basis").otherwise("scope_basis"), said, search, F.lit("abc"), F.lit(0)).alias("certified"))


@query("stale_certificates", """SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 4 = 0 THEN 'no certificate' ELSE concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'subject changed' END, CASE WHEN p_size % 3 = 0 THEN 'corpus changed' END, CASE WHEN p_size % 5 = 0 THEN 'not certified' END) END AS reasons FROM part""")
def stale_certificates(spark, sf_dir):
    s = F.col("p_size")
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "rule_id")
    certs = p.where("rule_id % 4 > 0").select("rule_id", F.when(s % 2 == 0, "old").otherwise(F.sha2("p_name", 256)).alias("subject_sha256"), F.when(s % 3 == 0, "old").otherwise("d").alias("corpus_sha256"), F.when(s % 5 == 0, "held").otherwise("certified").alias("verdict"))
    out = R.stale_certificates(certs, p.select("rule_id", F.sha2("p_name", 256).alias("subject_sha256")), F.lit("d"))
    return out.select("rule_id", F.array_join("reasons", ",").alias("reasons"))


@query("semantic_results", """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'unknown pair' WHEN event_id % 17 = 0 AND event_id % 13 <> 0 THEN 'duplicate pair' WHEN event_type = 'error' THEN 'invalid relationship' WHEN value > 300 THEN 'score out of range' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'contradiction without evidence' END AS fault FROM events""")
def semantic_results(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        "event_id", k.alias("pair_id"), F.when(F.col("event_type") == "error", "SAME").when(F.col("event_type") == "click", "contradictory").otherwise("Identical").alias("relationship"), (F.col("value") / 3).alias("similarity_score"), F.lit(0.5).alias("confidence"),
        F.when(k % 2 == 1, '{"shared_subject": "a", "shared_scope": "b", "old_requirement": "c", "new_requirement": "d", "incompatibility": "e"}').otherwise('{"shared_subject": "a", "shared_scope": " "}').alias("contradiction"),
    )
    twice = e.unionByName(e.where("event_id % 17 = 0"))
    return R.validated_results(e.where("event_id % 13 <> 0").select("pair_id"), twice).select("event_id", "fault").distinct()
