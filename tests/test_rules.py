import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.functions.dialect import glob_to_java, js_to_java, nested_quantifier
from spanforge.operators.evaluate import catalog_frame, dimension, evaluate, listed, strictest_candidate
from spanforge.plans.rules import Config, Condition, Match, Rule, RuleError, Spans, rule_of, rules_of

SCHEMA = "span_id int, kind string, label string, detail string, mcp_input string, file_path string, agent_id string, project_id string, tokens long, cached_tokens long, duration_ms long"


def test_rules_are_validated():
    good = {"id": "a", "match": {"any_of": [{"label": "Bash", "detail_matches": ["rm"]}]}}
    assert rule_of(good).severity == "medium" and rule_of(good).title == "a" and rule_of(good).action == "warn"
    for bad in (
        {"id": "", "match": good["match"]}, {"id": "a", "match": {}}, {"id": "a", "match": {"none_of": [{"label": "x"}]}}, {**good, "more": 1},
        {"id": "a", "match": {"any_of": [{"detail_matches": ["(a+)+"]}]}}, {"id": "a", "match": {"any_of": [{"detail_matches": ["x"] * 11}]}},
        {"id": "a", "match": {"any_of": [{"numeric": [{"field": "cost", "op": "gt", "value": 1}]}]}}, {"id": "a", "match": {"any_of": [{"unknown": 1}]}},
    ):
        with pytest.raises(RuleError):
            rule_of(bad)
    kept, why = rules_of([good, {"id": "x"}])
    assert [r.id for r in kept] == ["a"] and len(why) == 1


def test_config_drops_what_it_cannot_read():
    c = Config.of({"disabledPacks": ["p", 3], "disabledGuardrails": "no list", "guardrailActionOverrides": {"a": "warn", "b": "nothing"}, "allowlist": [{"guardrail": "a", "pattern": "x"}, {"guardrail": 1}]})
    assert c == Config(frozenset({"p"}), frozenset(), (("a", "warn"),), (("a", "x"),))
    assert Config.of(None) == Config()


@pytest.mark.parametrize("pattern, refused", [("(a+)+", True), ("(a*b)*", True), ("(a|b)+", False), (r"\(a+\)+", False), ("[a+]+", False), ("((a+))*", True), ("a+b*", False)])
def test_nested_quantifiers(pattern, refused):
    assert nested_quantifier(pattern) == refused


def test_dialect(spark):
    cases = [
        ("a$", "a\n", False), ("a$", "A", True), (r"\brm\b", "érm -x", True), (r"a\sb", "a\u00a0b", True), ("[<[]x", "[x", True), ("é", "É", True),
        ("a.b", "a\nb", False), (r"[^]", "\n", True), (r"x[&&]y", "x&y", True), (r"\Sa", " a", False),
    ]
    for p, text, want in cases:
        assert spark.sql("select 1").select(F.lit(text).rlike(js_to_java(p))).first()[0] == want, (p, text)


def test_globs(spark):
    cases = [
        ("*.py", "a.py", True), ("*.py", "b/a.py", False), ("**/*.py", "a.py", True), ("**/*.py", "x/y/.a.py", True), ("src/**", "src/a/b", True), ("src/**", "src", True),
        ("{a,b}.txt", "B.txt", True), ("{Bash}", "Bash", False), ("{Bash}", "{bash}", True), ("mcp__*", "mcp__x__y", True), ("a?c", "abc", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False),
        ("!(a|b)", "c", True), ("!(a|b)", "a", False), ("@(a|b)/x", "b/x", True), ("*(a|b)", "abba", True), ("f{1..3}", "f2", True), ("!*.md", "a.txt", True), ("./a", "a", True),
    ]
    for g, text, want in cases:
        assert spark.sql("select 1").select(F.lit(text).rlike(glob_to_java(g))).first()[0] == want, (g, text)
    assert not spark.sql("select 1").select(F.lit("A").rlike(glob_to_java("a", ignore_case=False))).first()[0]


def plain(rule, s):
    """A row-by-row evaluator for comparison."""

    def cond(c):
        if c.kind is not None and (s["kind"] or "").lower() != c.kind.lower():
            return False
        if c.label is not None and not (s["label"] is not None and re.fullmatch(c.label.replace("*", ".*"), s["label"], re.I)):
            return False
        content = s["mcp_input"] if s["mcp_input"] is not None else s["detail"]
        channel = c.channel or ("content" if (c.label or "").startswith("mcp__") else "command")
        text = content if channel == "content" else s["detail"]
        if c.detail_contains and not (text is not None and all(x in text for x in c.detail_contains)):
            return False
        if c.detail_matches and not (text is not None and any(re.search(p, text, re.I) for p in c.detail_matches)):
            return False
        return all(s[n.field] is not None and {"gt": s[n.field] > n.value, "gte": s[n.field] >= n.value, "lt": s[n.field] < n.value, "lte": s[n.field] <= n.value}[n.op] for n in c.numeric)

    m = rule.match
    return all(map(cond, m.all_of)) and (not m.any_of or any(map(cond, m.any_of))) and not any(map(cond, m.none_of))


def test_compiled_rules_equal_a_plain_evaluator(spark):
    from spanforge.plans.rules import Numeric

    rnd = random.Random(5)
    pick = lambda *x: rnd.choice(x)
    spans = [(i, pick("execute_tool", "llm", None), pick("Bash", "mcp__a__b", "Read", None), pick("rm -rf x", "RM x", "ls", "", None), pick(None, '{"q": "rm"}', "none"), None, "a", "p", pick(0, 5, None), 0, pick(1, 9)) for i in range(60)]
    cond = lambda: Condition(pick(None, None, "LLM"), pick(None, "bash", "mcp__*"), pick((), ("rm",), ("rm", "x")), pick((), ("rm|ls",), ("^x", "S$")), None, pick((), (Numeric("tokens", pick("gt", "lte"), 3),)), pick(None, None, "content", "command"))
    rules = []
    for i in range(25):
        groups = {g: tuple(cond() for _ in range(rnd.randint(0, 2))) for g in ("any_of", "all_of", "none_of")}
        if groups["any_of"] or groups["all_of"]:
            rules.append(Rule(f"r{i}", Match(**groups), action=pick("block", "require_approval", "warn")))
    df = spark.createDataFrame(spans, SCHEMA)
    rows = {r["span_id"]: r for r in evaluate(df, rules).collect()}
    for s in df.collect():
        want = [r for r in rules if plain(r, s)]
        got = rows[s["span_id"]]
        assert [m["rule_id"] for m in got["matches"]] == [r.id for r in want]
        first = next((r.id for a in ("block", "require_approval") for r in want if r.action == a), None)
        assert got["policy_id"] == first
        assert got["verdict"] == ("deny" if any(r.action == "block" for r in want) else "require_approval" if first else "allow")


def test_allow_scope_explain_and_catalog(spark):
    df = spark.createDataFrame([(1, "execute_tool", "Bash", "rm a/b", None, None, "x", "p", 0, 0, 0), (2, "execute_tool", "Bash", "rm c", None, None, "y", "p", 0, 0, 0)], SCHEMA)
    r = Rule("r", Match(any_of=(Condition(label="Bash", detail_contains=("rm",)),)), "pack", agent_in=("x", "y"))
    ids = lambda c=None, **k: [x["span_id"] for x in evaluate(df, [Rule(**{**r.__dict__, **k})], c).where("size(matches) > 0").orderBy("span_id").collect()]
    assert ids() == [1, 2] and ids(agent_in=("x",)) == [1] and ids(agent_in=()) == []
    assert ids(Config(allow=(("r", "rm c"),))) == [1] and ids(Config(allow=(("r", "RM c"),))) == [1, 2]
    assert ids(Config(disabled_packs=frozenset({"pack"}))) == [] and ids(Config(disabled_rules=frozenset({"r"}))) == []
    why = evaluate(df, [r], explain=True).first()["explain"]["r"]
    assert why == ["any_of[0]: holds"]
    cat = catalog_frame(spark, [r, Rule("r", r.match, "other"), Rule("q", r.match, "pack", owasp=("A1",))])
    assert dimension(cat).count() == 2 and dimension(cat).where("rule_id = 'r'").first()["category"] == "other"
    assert [x["rule_id"] for x in listed(cat, Config(frozenset({"other"})), packs=["pack"], owasp=["A1"], only="enabled").collect()] == ["q"]


def test_strictest_candidate_takes_the_earliest_of_equals(spark):
    df = spark.createDataFrame([(1, 0, "warn"), (1, 1, "block"), (1, 2, "block"), (2, 0, "none"), (2, 1, "none")], "call int, pos int, strictest string")
    assert {(r["call"], r["pos"]) for r in strictest_candidate(df, ["call"], "pos").collect()} == {(1, 1), (2, 0)}


def test_spans_without_optional_columns(spark):
    columns = Spans(kind="'llm'", label="name", detail="text", mcp_input=None, file_path=None, agent=None, project=None, tokens=None, cached_tokens=None, duration_ms=None)
    df = spark.createDataFrame([("x", None), (None, "a")], "name string, text string")
    r = Rule("r", Match(all_of=(Condition(detail_contains=("a",)),), none_of=(Condition(label="x"),)))
    assert [len(x["matches"]) for x in evaluate(df, [r], columns=columns).collect()] == [0, 1]
