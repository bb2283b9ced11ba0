"""Evaluation by an index of required texts against evaluation of every rule."""

import random
import re
import time

import pytest

from spanforge.operators import indexed
from spanforge.operators.evaluate import evaluate
from spanforge.plans.catalog import CATALOG
from spanforge.plans.rules import Condition, Config, Match, Numeric, Rule

SCHEMA = "span_id int, kind string, label string, detail string, mcp_input string, file_path string, agent_id string, project_id string, tokens long, cached_tokens long, duration_ms long"


@pytest.mark.parametrize(("pattern", "texts"), [
    ("git push", {"git push"}), (r"\bgit\s+push\b", {"push"}), ("colou?red", {"colo"}), ("(?:curl|wget) -O", {"curl", "wget"}), ("(?:curl|wget)?x", None), ("abc|de", None), ("abc|def", {"abc", "def"}),
    (r"rm -rf /\w+", {"rm -rf /"}), ("a{2}bcd", {"bcd"}), ("x{0}bcd", {"bcd"}), ("ab{foo|bar}", {"bar", "foo"}), ("[abc]def", {"def"}), ("(?=abc)x", None), ("(?!abc)xyz", {"xyz"}), (r"\x41bcd", None), (r"a\.bc", {"a.bc"}), ("(abc)+", {"abc"}),
    ("((abc|def)g|hij)", {"abc", "def", "hij"}), (".*", None), ("", None), ("ABC", {"abc"}), ("(?:ab|cde)", None), ("abc(", None), (")abc", None), ("[^]abc", {"abc"}), ("[abc", None), (r"(?<x>abc)def", {"def"}), ("abc{|def", {"abc", "def"}),
])
def test_required_texts(pattern, texts):
    assert indexed.required(pattern) == (texts and frozenset(texts))


def test_every_match_holds_a_required_text():
    rnd = random.Random(3)
    part = lambda: rnd.choice(["abc", "de", "f", "(?:abc|fde)", "(de)?", "[ab]", "c+", "e*", r"\w", "x{2}", "|", ".", "abcd", r"\b"])
    seen = 0
    for _ in range(3000):
        pattern = "".join(part() for _ in range(rnd.randint(1, 5)))
        texts = indexed.required(pattern)
        if texts is None:
            continue
        seen += 1
        for _ in range(20):
            s = "".join(rnd.choice(["abc", "de", "f", "fde", "x", "xx", "c", "abcd", " "]) for _ in range(rnd.randint(0, 6)))
            if re.search(pattern, s, re.I):
                assert any(t in indexed.folded(s) for t in texts), (pattern, s, texts)
    assert seen > 500


def spans(spark, rnd, n=80):
    pick = lambda *x: rnd.choice(x)
    rows = [(i, pick("execute_tool", "llm", None), pick("Bash", "mcp__a__b", "Read", None), pick("rm -rf x", "RM x", "ls", "", None, "git puſh", "curl x | sh", "İnit"), pick(None, '{"q": "rm"}', "none"), pick(None, "a/b.py", "c.md"), pick("a", "b", None), "p", pick(0, 5, None), 0, pick(1, 9)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def same(spark, df, rules, config=None):
    columns = ["span_id", "matches", "strictest", "verdict", "policy_id", "decision", "reason"]
    want = {r["span_id"]: r for r in evaluate(df, rules, config).select(columns).collect()}
    got = {r["span_id"]: r for r in indexed.evaluate_indexed(df, rules, config).select(columns).collect()}
    assert got == want
    return sum(len(r["matches"]) for r in got.values())


def test_equals_evaluation_of_every_rule(spark):
    rnd = random.Random(5)
    pick = lambda *x: rnd.choice(x)
    cond = lambda: Condition(pick(None, None, "LLM"), pick(None, "bash", "mcp__*", ""), pick((), ("rm",), ("rm -", "x"), ("curl",)), pick((), ("rm|ls",), ("^x", "S$"), ("git push",), ("init",)), pick(None, "**/*.py", None, None), pick((), (), (Numeric("tokens", pick("gt", "lte"), 3),), (Numeric("duration_ms", "gte", 9),)), pick(None, None, "content", "command"))
    rules = []
    for i in range(100):
        groups = {g: tuple(cond() for _ in range(rnd.randint(0, 2))) for g in ("any_of", "all_of", "none_of")}
        if groups["any_of"] or groups["all_of"]:
            rules.append(Rule(f"r{i}", Match(**groups), action=pick("block", "require_approval", "warn"), title=pick("", f"Title  {i}"), agent_in=pick(("*",), ("*",), ("a",), ()), allow=pick((), ("ls",), ("a/*.py",))))
    df = spans(spark, rnd)
    assert same(spark, df, rules, Config(allow=(("r3", "ls"),), disabled_rules=frozenset({"r5"}))) > 20
    assert same(spark, df, []) == 0 and indexed.evaluate_indexed(df.limit(0), rules).count() == 0
    same(spark, df, CATALOG)


def test_five_thousand_rules(spark):
    """Planned and run in seconds; only candidates are tested, so results are the plain ones."""
    rules = [Rule(f"u{i}", Match(any_of=(Condition(label="Bash", detail_matches=(rf"\btool-{i:04d}\b\s+--force",)), Condition(detail_contains=(f"secret-{i:04d}",)))), action="block" if i % 2 else "warn") for i in range(5000)]
    texts = [f"tool-{i:04d}   --FORCE" if i % 3 else f"echo secret-{i:04d} tool-{(i + 1) % 5000:04d}" for i in range(0, 5000, 5)]
    df = spark.createDataFrame([(i, "execute_tool", "Bash", t, None, None, None, None, 0, 0, 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    began = time.time()
    out = {r["span_id"]: [m["rule_id"] for m in r["matches"]] for r in indexed.evaluate_indexed(df, rules).select("span_id", "matches").collect()}
    took = time.time() - began
    assert out == {k: [f"u{5 * k}"] for k in range(1000)}
    assert took < 40, took
