"""Queries on single operators: call mapping, channels, reasons, tallies, readers of paths, hosts and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import readers, redact, shell
from .operators import aggregate, evaluate, mapping, verify
from .plans.catalog import CATALOG as SHIPPED
from .plans.rules import Spans
from .queries import EVENTS, _t, evaluated, query, rule, spread


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    """events with their id as text and a number from 0 to 5."""
    return _t(spark, d, "events"), F.col("event_id").cast("string"), F.col("event_id") % 6


def _pick(k: Column, *values) -> Column:
    out = F.lit(None)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(k == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ls ' || event_id WHEN 3 THEN 'q' || event_id WHEN 4 THEN '{"k":' || event_id || '}' WHEN 5 THEN 'c' END AS full_command,
CASE event_id % 6 WHEN 1 THEN 'C:/a/' || event_id WHEN 2 THEN 'src/*.py' WHEN 5 THEN 'f' || event_id END AS file_path FROM events""")
def mapped_calls(spark, d):
    rows, n, k = _events(spark, d)
    source = _pick(k, F.concat(F.lit('{"command":"ls '), n, F.lit('"}')), F.concat(F.lit('{"file_path":"C:\\\\a\\\\'), n, F.lit('"}')), F.lit('{"glob":"*.py","path":"src/"}'), F.concat(F.lit('{"query":"q'), n, F.lit('"}')), F.concat(F.lit('{"k":'), n, F.lit("}")), F.concat(F.lit('{"command":"c","file_path":"f'), n, F.lit('"}')))
    calls = rows.select("event_id", _pick(k, "Bash", "Read", "Grep", "WebSearch", "mcp__a__b", "Other").alias("name"), source.alias("input"))
    return mapping.to_spans(mapping.map_tool_calls(calls)).select("event_id", "full_command", "file_path")


@query("SELECT event_id, unnest(['a' || event_id, 'c', 'd']) AS path FROM events")
def patch_files(spark, d):
    rows, n, _ = _events(spark, d)
    text = F.concat(F.lit("*** Begin Patch\n*** Add File: a"), n, F.lit("\n+x\n*** Update File: c  \n*** Move to: d\n+*** Add File: no\n"))
    return rows.select("event_id", F.explode(mapping.patch_candidates(text)).alias("p")).select("event_id", F.col("p.file_path").alias("path"))


@query("SELECT event_id, greatest(0, event_id % 100 - 30 - event_id % 7)::BIGINT AS input_tokens FROM events")
def usage_normalized(spark, d):
    rows, _, _ = _events(spark, d)
    return rows.select("event_id", mapping.normalized_usage(F.col("event_id") % 100, F.lit(30), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 7)).cast("long").alias("input_tokens"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN '<unnamed>' WHEN 1 THEN '<unnamed>' WHEN 2 THEN 'Tool_' || event_id WHEN 3 THEN '<other>' WHEN 4 THEN 'my tool' ELSE '<other>' END AS shown FROM events")
def tool_names_shown(spark, d):
    rows, n, k = _events(spark, d)
    return rows.select("event_id", mapping.sanitized_tool(_pick(k, None, "  ", F.concat(F.lit("Tool_"), n), F.concat(F.lit("/srv/"), n), "my tool", F.concat(F.lit("x"), F.repeat(n, F.lit(70)))), ("my tool",)).alias("shown"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"a\":\"<value>\"}' WHEN event_id % 3 = 1 THEN 'cat <path> x ' || event_id ELSE 'ssh <host> ls' END AS shape FROM events")
def display_shapes(spark, d):
    rows, n, _ = _events(spark, d)
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit('{"a": '), n, F.lit("}"))).when(k == 1, F.concat(F.lit("cat  src/a.py\n x  "), n)).otherwise(F.concat(F.lit("ssh db"), n, F.lit(" ls")))
    return rows.select("event_id", mapping.display_shape(F.when(k == 0, "mcp__a__b").otherwise("Bash"), text).alias("shape"))


@query("SELECT event_id FROM events WHERE event_id % 6 IN (0, 4) OR (event_id % 6 = 2)")
def rule_channel(spark, d):
    """A rule on mcp labels reads the content, another the command, unless it names its channel."""
    rows, _, k = _events(spark, d)
    calls = rows.select("event_id", _pick(k, "mcp__a", "mcp__a", "Bash", "Bash", "Bash", "Read").alias("tool"), _pick(k, "x", "secret", "secret", "x", "x", "x").alias("detail"), _pick(k, "secret", "x", "x", "secret", "in secret", "x").alias("content"))
    spans = Spans(kind="'execute_tool'", label="tool", detail="detail", mcp_input="content", file_path=None, agent=None, project=None, tokens=None, cached_tokens=None, duration_ms=None)
    r = rule("r", any_of=[{"label": "mcp__*", "detail_contains": ["secret"]}, {"label": "Bash", "detail_contains": ["secret"]}, {"channel": "content", "detail_contains": ["in secret"]}])
    return evaluate.evaluate(calls, [r], columns=spans).where(F.size("matches") > 0).select("event_id")


@query("""SELECT event_id, event_type IN ('click', 'view') AND coalesce(value > 5, false) AND NOT contains(coalesce(props, ''), '"k": 1') AS matched,
CASE WHEN coalesce(value > 5, false) THEN 'all_of[0]: holds' ELSE 'all_of[0]: not tokens gt 5' END || '; ' || CASE WHEN event_type = 'click' THEN 'any_of[0]: holds' ELSE 'any_of[0]: not label matches click' END || '; ' || CASE WHEN event_type = 'view' THEN 'any_of[1]: holds' ELSE 'any_of[1]: not label matches view' END || '; ' ||
CASE WHEN contains(coalesce(props, ''), '"k": 1') THEN 'none_of[0]: holds' ELSE 'none_of[0]: not detail contains "k": 1' END AS reasons FROM events""")
def rule_reasons(spark, d):
    """Every evaluation says of each condition that it holds, or the first of its fields that doesn't."""
    r = rule("r", any_of=[{"label": "click"}, {"label": "view"}], all_of=[{"numeric": [{"field": "tokens", "op": "gt", "value": 5}]}], none_of=[{"detail_contains": ['"k": 1']}])
    rows = evaluate.evaluate(_t(spark, d, "events"), [r], columns=EVENTS, explain=True)
    return rows.select("event_id", (F.size("matches") > 0).alias("matched"), F.array_join(F.col("explain")["r"], "; ").alias("reasons"))


@query("""WITH a AS (SELECT event_id % 4 AS k, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS t FROM a WHERE k < 3)
SELECT 'a,b' AS rules, (SELECT sum(n) FROM a WHERE k IN (0, 1))::BIGINT AS removed, t::BIGINT AS asks FROM t""")
def tuning_hint(spark, d):
    rows = _t(spark, d, "events").select((F.col("event_id") % 4).alias("k"))
    decided = rows.select(F.when(F.col("k") == 3, "block").otherwise("require_approval").alias("action"), _pick(F.col("k"), "a", "a,b", "c,d", "e").alias("rule_ids")).groupBy("action", "rule_ids").agg(F.count("*").alias("calls"))
    hint = aggregate.tuning_hint_of(decided)
    return spark.createDataFrame([(",".join(hint["rules"]), hint["removed"], hint["asks"])], "rules string, removed long, asks long")


@query(r"""WITH e AS (SELECT *, event_id % 8 AS k, event_id::VARCHAR AS n FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'git -C /w/a branch -- topic-' || n || ' 0123abc' WHEN 1 THEN 'git -C ''/w/b c'' branch -- ''it''\''''s ' || n || ''' 0123abc' WHEN 3 THEN 'git -C /w/a stash apply 0123abc' WHEN 4 THEN 'git -C ''/w/b c'' config --unset core.hooksPath'
  WHEN 5 THEN 'git -C /w/a restore -- ''src/x y' || n || '.py''' WHEN 6 THEN 'pkill -x -- ngrok' END AS command, CASE k WHEN 2 THEN 'no safe command' WHEN 7 THEN 'no fix' END AS left_out FROM e""")
def fix_commands(spark, d):
    """Commands that undo what the checks found, for those who own the machine; none where a name can't be written safely."""
    from .sources import report

    rows, n, _ = _events(spark, d)
    k = F.col("event_id") % 8
    kind = F.when(k < 3, "branch-delete").when(k == 3, "stash-drop").when(k == 4, "hooks-path").when(k == 5, "tracked-missing").when(k == 6, "tunnel").otherwise("iam")
    name = F.when(k == 0, F.concat(F.lit("topic-"), n)).when(k == 1, F.concat(F.lit("it's "), n)).when(k == 2, F.concat(F.lit("a\nrm "), n)).when(k == 5, F.concat(F.lit("src/x y"), n, F.lit(".py"))).when(k == 6, "ngrok")
    found = rows.select("event_id", F.lit("lost-work").alias("category"), kind.alias("kind"), F.when(k.isin(1, 4), "/w/b c").otherwise("/w/a").alias("folder"), name.alias("name"), F.when(k < 4, "0123abc").alias("hash"))
    return report.fixes(found).select("event_id", "command", "left_out")


#: Commands with a -p, and whether it is a database client's password; {n} differs from row to row.
PASSWORDS = [
    ("mysql -u root -ps3cret{n} shop", True), ("sudo -u bob /usr/bin/mysqldump -h db -ps3cret{n} shop > d.sql", True), ("docker exec -it -e A=b shop-db mysql -uroot -ps3cret{n}", True), ("docker run --name mysql -p3306:{n} mysql:8", False),
    ("kubectl -n shop exec db-0 -c main -- mariadb-dump -ps3cret{n} shop", True), ("ssh -p 22 db.example.com mysql -ps3cret{n}", True), ("find /var/lib/mysql -path x{n}", False), ("echo mysql; tar -ps3cret{n}", False),
    ("run: mysql -ps3cret{n}", True), ('CMD ["mysql", "-uroot", "-ps3cret{n}"]', True), ("ssh db 'mysql -ps3cret{n}'", True), ("mysql -port {n}", False), ("mysql -u r \\\n  -p's3 cret{n}'", True), ("cat mysql.cnf | cut -ps3cret{n}", False), ("MYSQL_PWD=x mysqladmin -ps3cret{n} ping", True),
]


@query(f"SELECT event_id, event_id % {len(PASSWORDS)} IN ({', '.join(str(i) for i, (_, yes) in enumerate(PASSWORDS) if yes)}) AS masked FROM events")
def client_passwords(spark, d):
    """-p is a password only where the statement's program, or the one run in a container or on a host, is a client that takes it so."""
    rows, n, _ = _events(spark, d)
    texts = F.array(*[F.lit(t) for t, _ in PASSWORDS])
    text = F.replace(F.get(texts, (F.col("event_id") % len(PASSWORDS)).cast("int")), F.lit("{n}"), n)
    done = rows.select("event_id", redact.scrub(text).alias("r"))
    gone = ~F.contains("r.text", F.lit("cret"))
    return done.select("event_id", (F.coalesce(F.try_element_at("r.counts", F.lit("mysql-password-flag")) > 0, F.lit(False)) & gone).alias("masked"))


@query("SELECT event_id, event_id % 6 IN (0, 4) AS random FROM events")
def random_tokens(spark, d):
    """Long tokens that look generated, beside ids of known shapes, digests in hexadecimal, names and words."""
    rows, n, k = _events(spark, d)
    digest = F.sha2(n, 256)
    made = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(n, F.lit("k")), 256))), "[0-9]{3,}", "x7")
    uuid = F.concat_ws("-", digest.substr(1, 8), digest.substr(9, 4), digest.substr(13, 4), digest.substr(17, 4), digest.substr(21, 12))
    token = _pick(k, F.concat(F.lit("Q5"), made), digest, uuid, F.concat(F.lit("some_rather_long_name_of_a_function_"), F.lpad((F.col("event_id") % 1000).cast("string"), 4, "0")), F.concat(F.lit("Ab3+"), made), F.concat(F.lit("AlphabeticalOrderingConfigurations"), F.col("event_id") % 10))
    counts = redact.scrub(F.concat(F.lit("use "), token, F.lit(" now")))["counts"]
    return rows.select("event_id", F.coalesce(F.try_element_at(counts, F.lit("generic-secret")) > 0, F.lit(False)).alias("random"))


@query("SELECT count(DISTINCT user_id) AS projects FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAYS")
def stepped_aside(spark, d):
    log = _t(spark, d, "events").select(F.col("ts").cast("string").alias("ts"), F.when(F.col("event_type") == "error", "stepped-aside").alias("event"), F.col("user_id").alias("project"))
    return aggregate.stepped_aside_projects(log, _t(spark, d, "events").select(F.max("ts")).scalar())


@query("SELECT event_type AS name, count(*) AS calls FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1")
def unmapped_tools(spark, d):
    return aggregate.unmapped_tools(_t(spark, d, "events").select(F.col("event_type").alias("name"), F.when(F.col("event_type").isin("signup", "error"), "unmapped").otherwise("action").alias("kind")))


@query("SELECT unnest(['email', 'jwt', 'ssn']) AS pattern, unnest([count(*) FILTER (event_id % 2 = 0), count(*) FILTER (event_id % 3 = 0), 2 * count(*) FILTER (event_id % 5 = 0)])::BIGINT AS hits FROM events")
def redaction_tally(spark, d):
    n = F.col("event_id")
    text = F.concat_ws(" ", F.when(n % 2 == 0, F.concat(F.lit("u"), n, F.lit("@h.io"))), F.when(n % 3 == 0, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdef"), F.when(n % 5 == 0, "123-45-6789 223-45-6789"), F.lit("end"))
    rows = _t(spark, d, "events").select(F.explode(redact.scrub(text)["counts"]).alias("pattern", "n"))
    return rows.groupBy("pattern").agg(F.sum("n").alias("hits"))


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS o FROM events),
s AS (SELECT *, o % 5 AS k, event_id % 4 <> 0 AS ok FROM o),
g AS (SELECT *, sum((k IN (0, 3) OR (k = 1 AND NOT ok))::INT) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run,
  last_value(CASE WHEN k = 0 THEN CASE WHEN ok THEN '/srv' ELSE '' END WHEN k = 3 THEN '/reset' WHEN k = 1 AND NOT ok THEN '' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM s),
c AS (SELECT *, coalesce(sum((k = 1 AND ok)::INT) OVER (PARTITION BY user_id, coalesce(run, 0) ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS steps FROM g)
SELECT event_id, CASE WHEN o = 0 THEN '/home' WHEN base = '' THEN NULL ELSE coalesce(base, '/home') || repeat('/sub', steps::INT) END AS folder FROM c""")
def working_folders(spark, d):
    """Each user's calls change the folder to /srv, go below it, list, are put back to /reset, and list again."""
    from .operators.sequence import call_order

    rows = call_order(spread(_t(spark, d, "events").select("user_id", "event_id"), "user_id"), ["user_id"], ["event_id"])
    k = F.col("call_order") % 5
    ok = F.col("event_id") % 4 != 0
    calls = rows.select(F.col("user_id").alias("session_key"), "call_order", "event_id", F.lit("/home").alias("cwd"), _pick(k, "cd /srv", "cd sub && ls", "ls", "make", "ls").alias("full_command"), F.lit(True).alias("has_result"), (~ok).alias("is_error"), F.when(k == 3, "Shell cwd was reset to /reset").otherwise("done").alias("content"))
    return verify.folders(calls).select("event_id", "folder")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN '7' WHEN 1 THEN '1.2K' WHEN 2 THEN '999' WHEN 3 THEN '2.5M' WHEN 4 THEN '1.0K' ELSE '3.1B' END AS shown FROM events")
def short_counts(spark, d):
    rows, _, k = _events(spark, d)
    return rows.select("event_id", mapping.short_count(_pick(k, 7, 1234, 999, 2_500_000, 1000, 3_199_999_999).cast("long")).alias("shown"))


@query("SELECT event_id, event_id % 6 IN (0, 3) AS card FROM events")
def card_numbers(spark, d):
    rows, n, k = _events(spark, d)
    text = _pick(k, "4111-1111-1111-1111", "4111 1111 1111 1112", "12", "5500 0000 0000 0004", "no digits", F.concat(F.lit("0"), F.lpad(n, 21, "1")))
    return rows.select("event_id", redact.card_number(text).alias("card"))


@query("SELECT event_type, count(DISTINCT props) AS keys FROM events GROUP BY 1")
def dedupe_keys(spark, d):
    """A record's key is a hash of what makes it the same record: equal for equal records only."""
    key = F.xxhash64("event_type", "props")
    return _t(spark, d, "events").where("props is not null").groupBy("event_type").agg(F.countDistinct(key).alias("keys"))


@query(f"SELECT 'library' AS source, {len(SHIPPED)}::BIGINT AS rules UNION ALL SELECT 'yours', count(*) FROM part WHERE p_partkey % 7 <> 6")
def shipped_and_own_rules(spark, d):
    """The shipped catalog and the user's own rules, those of the parts that can be read; an own rule with a shipped id would still be the user's."""
    from .operators import rule_admin
    from .queries_sources import _part_rules

    own = rule_admin.read_rules(_part_rules(spark, d)).where("read.problem is null").select(F.col("read.id").alias("rule_id"), F.lit("yours").alias("source"))
    return evaluate.catalog_frame(spark, SHIPPED).select("rule_id", "source").union(own).groupBy("source").agg(F.count("*").alias("rules"))


@query("SELECT event_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['main', 'x' || event_id] ELSE ['dev'] END) AS branch, unnest(CASE WHEN event_id % 2 = 0 THEN ['4567def', NULL] ELSE ['abcdef0'] END) AS to_hash FROM events")
def pushed_refs(spark, d):
    rows, n, _ = _events(spark, d)
    output = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("To h\r\n   0123abc..4567def  main -> main\r\n * [new branch]      y -> x"), n)).otherwise(" + 1234567...abcdef0 dev -> dev (forced update)\n ! [rejected] a -> a")
    return rows.select("event_id", F.explode(readers.pushed_refs(output)).alias("r")).select("event_id", "r.branch", "r.to_hash")


@query("SELECT event_id, event_id % 6 IN (0, 1, 2) AS test, event_id % 6 = 3 AS config, event_id % 6 = 4 AS ci FROM events")
def test_paths(spark, d):
    rows, n, k = _events(spark, d)
    path = _pick(k, F.concat(F.lit("src/a"), n, F.lit(".test.ts")), F.concat(F.lit("t/test_"), n, F.lit(".py")), F.concat(F.lit("x/__tests__/"), n), "app/vitest.config.mts", ".github/workflows/ci.yml", F.concat(F.lit("dist/a"), n, F.lit(".test.js")))
    return rows.select("event_id", readers.is_test_path(path).alias("test"), readers.is_test_config(path).alias("config"), readers.is_ci_file(path).alias("ci"))


@query("SELECT event_id, event_id % 6 IN (0, 1) AS lowers, event_id % 6 = 2 AS excludes, event_id % 6 = 3 AS passes, event_id % 6 = 4 AS forces FROM events")
def test_edits(spark, d):
    rows, n, k = _events(spark, d)
    removed = _pick(k, "coverage lines: 80, branches: 70", "thresholds: { lines: 80 }", "exclude: ['a']", "", "run: npm test", "coverage lines: 80")
    added = _pick(k, "coverage lines: 80, branches: 69.5", "thresholds: {}", "exclude: ['a', 'b']", "passWithNoTests: true", "run: npm test || exit 0", "coverage lines: 81")
    path = F.lit("vitest.config.ts")
    return rows.select("event_id", readers.lowers_threshold(path, removed, added).alias("lowers"), readers.adds_exclude(removed, added).alias("excludes"), (readers.passes_set(added) > readers.passes_set(removed)).alias("passes"), (readers.steps_forced(added) > readers.steps_forced(removed)).alias("forces"))


@query("SELECT event_id, event_id % 6 IN (0, 1) AS failing FROM events")
def failing_tests(spark, d):
    rows, n, k = _events(spark, d)
    output = _pick(k, F.concat(F.lit("ok\n FAIL  src/a"), n, F.lit(".test.ts > x")), F.concat(F.lit("✗ a"), n, F.lit(".test.ts:3")), F.concat(F.lit(" FAIL src/data"), n, F.lit(".test.ts")), F.concat(F.lit("PASS a"), n, F.lit(".test.ts\nFAIL b.test.ts")), F.concat(F.lit("FAIL a"), n, F.lit(".test.tsx")), None)
    return rows.select("event_id", readers.names_as_failing(output, F.concat(F.lit("a"), n, F.lit(".test.ts"))).alias("failing"))


@query("SELECT event_id, event_id % 6 IN (0, 1, 2) AS instructions, event_id % 6 IN (1, 4) AS skips FROM events")
def instruction_files(spark, d):
    rows, n, k = _events(spark, d)
    path = _pick(k, F.concat(F.lit("/r"), n, F.lit("/CLAUDE.md")), "a/.cursor/rules/x.mdc", "AGENTS.md", "README.md", F.concat(F.lit("doc"), n, F.lit(".md")), "claude.md.txt")
    text = _pick(k, "never use --no-verify", "be quick:\nHUSKY=0 git push", "Don't skip the hooks", "run the checks", "always skip pre-commit hooks", "skip lunch")
    return rows.select("event_id", readers.is_instruction_file(path).alias("instructions"), readers.tells_to_skip(text).alias("skips"))


@query("SELECT event_id, event_id % 6 IN (0, 3, 4) AS here FROM events")
def local_targets(spark, d):
    """Commands on clusters and cloud endpoints of this machine only."""
    rows, n, k = _events(spark, d)
    command = _pick(k, F.concat(F.lit("kubectl --context kind-"), n, F.lit(" delete pod x")), "kubectl delete pod x", "kubectl --context minikube --server h delete pod x", "aws --endpoint-url http://localhost:4566 s3 rb s3://b | cat", "helm --kube-context=docker-desktop uninstall x; cd y", "KUBECONFIG=f kubectl --context minikube delete x")
    return rows.select("event_id", shell.reading(command)["here"].alias("here"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'h' || event_id || '.io' WHEN 1 THEN 'localhost' WHEN 2 THEN 'h.io' WHEN 3 THEN '' WHEN 4 THEN '[::1]' ELSE 'a.localhost' END AS host, event_id % 6 IN (1, 4, 5) AS local FROM events")
def hosts(spark, d):
    rows, n, k = _events(spark, d)
    target = _pick(k, F.concat(F.lit("https://u:p@h"), n, F.lit(".io:80/x?y@z")), "http://localhost:4566", "me@h.io:/srv", "plain", "http://[::1]:80/", "x://a.localhost")
    host = readers.host_of(target)
    return rows.select("event_id", host.alias("host"), readers.is_local(host).alias("local"))


@query("""WITH r AS (SELECT item_id, left(text, 60) AS passage FROM benchmark WHERE text IS NOT NULL AND length(text) >= 60), m AS (SELECT doc_id, count(*) AS rules, min(item_id) AS first_item FROM documents JOIN r ON contains(text, passage) GROUP BY 1)
SELECT doc_id, rules, first_item FROM m""")
def rules_of_passages(spark, d):
    """A rule for each benchmark passage, evaluated over all texts by the index of what rules need: documents with the rules that they match."""
    from .operators.indexed import evaluate_indexed
    from .plans.rules import Condition, Match, Rule

    passages = _t(spark, d, "benchmark").where("text is not null and length(text) >= 60").select("item_id", F.left("text", F.lit(60)).alias("p")).orderBy("item_id").limit(20_001).collect()
    if len(passages) > 20_000:
        raise ValueError("more than 20,000 rules: evaluate them in several catalogs")
    rules = [Rule(str(r["item_id"]), Match(any_of=(Condition(detail_contains=(r["p"],)),))) for r in passages]
    spans = Spans(kind="'execute_tool'", label="lang", detail="text", mcp_input=None, file_path=None, agent=None, project=None, tokens=None, cached_tokens=None, duration_ms=None)
    found = evaluate_indexed(_t(spark, d, "documents").select("doc_id", "lang", "text"), rules, columns=spans).where(F.size("matches") > 0)
    return found.select("doc_id", F.size("matches").cast("long").alias("rules"), F.col("matches")[0]["rule_id"].cast("long").alias("first_item"))


@query("SELECT count(*) AS calls, sum(len(coalesce(props, '')))::BIGINT AS size FROM events")
def partial_and_final(spark, d):
    """Whole-table aggregates go through partial sums of each task."""
    return evaluated(spark, d).agg(F.count("*").alias("calls"), F.sum(F.length(F.coalesce("props", F.lit("")))).alias("size"))
