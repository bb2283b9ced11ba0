"""What outputs, paths and edits tell: column expressions over texts. What commands do is read word by word (labels.py)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- hosts ---------------------------------------------------------------------------------------------------------


def host_of(target: Column) -> Column:
    """The host of a URL, of user@host:path or of host:port; empty where there is none."""
    there = target.contains("://")
    authority = F.regexp_extract(F.split_part(target, F.lit("://"), F.lit(2)), r"^[^/?#]*", 0)
    authority = F.regexp_replace(authority, "^.*@", "")
    of_url = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[[^\]]*\]", 0)).otherwise(F.split_part(authority, F.lit(":"), F.lit(1)))
    before = F.regexp_replace(F.when(target.startswith("["), F.regexp_extract(target, r"^\[[^\]]*\](?=:)", 0)).otherwise(F.regexp_extract(target, r"^([^:]*):", 1)), "^.*@", "")
    return F.when(there, of_url).otherwise(F.when(before.rlike(r"[/\s]"), "").otherwise(before))


def is_local(host: Column) -> Column:
    """Whether a host is this machine: a loopback address or name, what containers call their host, or a local stand-in for a cloud."""
    name = F.regexp_replace(F.lower(host), r"[\[\]]|\.$", "")
    last = F.element_at(F.split(name, r"\."), -1)
    loopback = name.isin("::1", "0.0.0.0", "ip6-localhost", "host.docker.internal") | name.rlike(r"^127\.\d+\.\d+\.\d+$")
    return loopback | last.isin("localhost", "localstack") | (name == "localstack.cloud") | name.endswith(".localstack.cloud")


# -- paths ---------------------------------------------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]"), -1)


def folder_names(path: Column) -> Column:
    """The names of the folders that a path goes through."""
    parts = F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def through(path: Column, *names: str) -> Column:
    return F.arrays_overlap(folder_names(path), F.array(*[F.lit(n) for n in names]))


BUILT = ("build", "coverage", "dist", "node_modules", "out", "target")  # folders that a build, an install or a test run makes again


def is_scratch(path: Column) -> Column:
    """Whether a name on the path says that it can be made again: built, temporary, or some tool's cache."""
    names = F.split(path, "/")
    hidden = r"^[._]*(?:py)?\w*cache_*$|^\.(?:angular|expo|gradle|next|nuxt|output|svelte-kit|turbo|vercel|vite)$|^\.?te?mp$|-static$"
    return F.exists(names, lambda x: x.isin(*BUILT) | x.rlike(hidden))


def resolved(path: Column, folder: Column, home: Column) -> Column:
    """A path in full, without . and ..; null where it hangs on a folder that isn't known."""
    rooted = F.regexp_replace(F.regexp_replace(path, "^~(?=/|$)", ""), "/+$", "")
    full = F.when(path.rlike("^~(?:/|$)"), F.concat(home, rooted)).when(path.startswith("/"), path).when(path.startswith("~"), F.lit(None).cast("string")).otherwise(F.concat(folder, F.lit("/"), path))
    parts = F.filter(F.split(full, "/"), lambda x: ~x.isin("", "."))
    climbed = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(climbed, "/"))


def removal(target: Column, folder: Column, home: Column) -> Column:
    """struct<label, path> of a target of a recursive rm: struct<word, expands, globs>, see labels.removed.

    Labels: rm:guarded-variable, rm:unguarded-variable, rm:could-not-check, rm:home-or-above, rm:scratch-name and rm:path.
    """
    w = target["word"]
    guarded = ~w.contains("`") & ~w.contains("$(") & ~F.regexp_replace(w, r"\$\{\w+:\?", "").contains("$")  # each variable as ${NAME:?}
    before = F.regexp_extract(w, r"^[^*?\[]*", 0)  # the first wildcard
    literal = F.when(target["globs"], F.when(before.contains("/"), F.regexp_replace(before, "[^/]*$", "")).otherwise(".")).otherwise(w)
    path = resolved(literal, folder, home)
    climbs = target["globs"] & F.array_contains(F.split(F.substr(w, F.length(before) + 1), "/"), "..")
    above = (path == "/") | (path == home) | F.startswith(home, F.concat(path, F.lit("/")))
    inside = F.when(F.startswith(path, F.concat(folder, F.lit("/"))), F.substr(path, F.length(folder) + 2)).otherwise(base_name(path))
    temporary = F.regexp_replace(path, "^/(?:private/)?(?:var/)?", "/").startswith("/tmp/")
    label = F.when(target["expands"], F.when(guarded, "rm:guarded-variable").otherwise("rm:unguarded-variable")).when(climbs | path.isNull(), "rm:could-not-check").when(above, "rm:home-or-above")
    label = label.when(temporary | is_scratch(inside), "rm:scratch-name").otherwise("rm:path")
    return F.struct(label.alias("label"), F.when(~target["expands"], path).alias("path"))


# -- outputs -------------------------------------------------------------------------------------------------------


def pushed_refs(output: Column) -> Column:
    """array<struct<from_hash, to_hash, branch>> of the refs that a push's output says were updated; hashes are null for new branches.

    git writes a line for each: a sign, then old..new (or [new branch]), then what it pushed -> the branch.
    """
    words = lambda x: F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")
    none = F.lit(None).cast("string")

    def one(line: Column) -> Column:
        w = words(F.regexp_replace(F.trim(line), r"^\+\s*", ""))
        at = F.array_position(w, "->")
        range_ = F.split(F.get(w, F.lit(0)), r"\.\.+")
        hashes = (F.size(range_) == 2) & F.forall(range_, lambda h: h.rlike("^[0-9a-f]{7,64}$"))
        branch = F.get(w, at.cast("int"))
        moved = F.struct(F.get(range_, F.lit(0)).alias("from_hash"), F.get(range_, F.lit(1)).alias("to_hash"), branch.alias("branch"))
        made = F.struct(none.alias("from_hash"), none.alias("to_hash"), branch.alias("branch"))
        new = (F.get(w, F.lit(0)) == "*") & (F.get(w, F.lit(1)) == "[new") & (F.get(w, F.lit(2)) == "branch]")
        return F.when((at == 3) & hashes, moved).when((at == 5) & new, made)

    return F.filter(F.transform(F.split(output, r"\r?\n"), one), lambda r: r.isNotNull())


def push_reported(output: Column) -> Column:
    """Whether a push's output says how it ended: what went where, or that nothing was to be done."""
    return F.coalesce(output.contains(" -> ") | F.replace(F.lower(output), F.lit("-"), F.lit(" ")).contains("up to date"), F.lit(False))


def reports_failure(line: Column) -> Column:
    """Whether a line of a test run reports a failure: FAIL or FAILED, a cross, or a number above 0 of failed ones."""
    words = F.split(line, r"[^\w]+")
    counted = F.exists(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i + 1).alias("then"))), lambda x: x["then"].isin("failed", "failing") & x["w"].rlike("^[1-9][0-9]*$"))
    return F.arrays_overlap(words, F.array(F.lit("FAIL"), F.lit("FAILED"))) | F.exists(F.array(*[F.lit(x) for x in "✗✘✕×❌"]), lambda x: F.contains(line, x)) | counted


_EDGE = r"[\s/\\\"'`()\[\],:>]+"  # what stands beside a path in an output


def pieces(line: Column) -> Column:
    """The distinct pieces of a line between blanks, quotes, brackets and slashes."""
    return F.filter(F.array_distinct(F.split(line, _EDGE)), lambda x: x != "")


def longest_piece(name: Column) -> Column:
    """The longest piece of a name: a line that names it has the piece among its own."""
    return F.element_at(F.array_sort(pieces(name), lambda a, b: F.length(a) - F.length(b)), -1)


def names(line: Column, name: Column) -> Column:
    """Whether a line holds a file's name as a whole part of a path."""
    quoted = F.concat(F.lit(r"(?:^|[\s/\\\"'`(\[])\Q"), name, F.lit(r"\E(?:$|[\s:\"'`)\],>])"))
    return (name != "") & F.contains(line, name) & F.call_function("regexp_like", line, quoted)


def names_as_failing(output: Column, name: Column) -> Column:
    """Whether a line that reports a failure names a file."""
    return F.exists(F.split(F.coalesce(output, F.lit("")), r"\r?\n"), lambda x: names(x, name) & reports_failure(x))


# -- tests -------------------------------------------------------------------------------------------------------------

_TOOLS = ("jest", "karma", "vite", "vitest")  # whose configuration is <tool>.config.* or <tool>.workspace.*
_COVERAGE = (".coveragerc", *(f".{t}rc{e}" for t in ("c8", "nyc") for e in ("", ".json", ".yaml", ".yml")), *(f"{d}codecov.{e}" for d in ("", ".") for e in ("yaml", "yml")))
_SHARED = ("package.json", "pyproject.toml", "pytest.ini", "setup.cfg", "tox.ini")  # files in which other tools' settings stand too
_PIPELINES = ("Jenkinsfile", *(f"{n}.{e}" for n in (".gitlab-ci", ".travis", "azure-pipelines", "bitbucket-pipelines") for e in ("yaml", "yml")))


def is_test_path(path: Column) -> Column:
    """Whether a path is a test's by its name or folder, and not something built."""
    name = base_name(path)
    parts = F.split(F.lower(name), r"[._]")
    stem = F.regexp_extract(F.lower(name), r"^(.*)\.([a-z0-9]+)$", 1)
    ends = F.element_at(F.concat(F.array(F.lit("")), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), -1)  # the part before the extension
    code = F.element_at(parts, -1)
    spec = (ends == "spec") | (ends == "test")
    python = F.lower(name).startswith("test_") & (code == "py") & (stem != "test_")
    return ~through(path, *BUILT[:-1]) & ((spec & (F.size(parts) > 2) & (stem != "")) | python | F.array_contains(F.split(path, r"[\\/]"), "__tests__"))


def is_coverage_config(path: Column) -> Column:
    return F.lower(base_name(path)).isin(*_COVERAGE)


def is_test_config(path: Column) -> Column:
    """Whether a file configures tests or their coverage."""
    name = F.lower(base_name(path))
    parts = F.split(name, r"\.")
    return name.isin(*_COVERAGE, *_SHARED) | (F.get(parts, F.lit(0)).isin(*_TOOLS) & F.get(parts, F.lit(1)).isin("config", "workspace") & (F.size(parts) > 2))


def is_ci_file(path: Column) -> Column:
    """Whether a file describes a pipeline that runs on pushes."""
    name, parts = base_name(path), F.split(path, r"[\\/]")
    folder = lambda k: F.try_element_at(parts, F.lit(k))
    yaml = name.rlike(r"\.ya?ml$")
    return name.isin(*_PIPELINES) | (yaml & (folder(-2) == "workflows") & (folder(-3) == ".github")) | (yaml & name.startswith("config.") & (folder(-2) == ".circleci")) | (folder(-2) == ".buildkite")


LIMITS = ("branches", "fail_under", "functions", "lines", "statements", "target")  # what coverage thresholds are called
_SETTING = r"([A-Za-z][\w-]*)[\"']?\s*[:=]\s*[\"']?(\d+(?:\.\d+)?)"


def limits(text: Column) -> Column:
    """array<struct<key, value>> of the numbers that a text gives to thresholds, in order."""
    keys = F.regexp_extract_all(text, F.lit(_SETTING), F.lit(1))
    found = F.arrays_zip(F.transform(keys, lambda k: F.replace(F.lower(k), F.lit("-"), F.lit("_"))).alias("key"), F.regexp_extract_all(text, F.lit(_SETTING), F.lit(2)).alias("value"))
    return F.filter(found, lambda x: x["key"].isin(*LIMITS))


def lowers_threshold(path: Column, removed: Column, added: Column) -> Column:
    """Whether an edit lowers a coverage threshold, place by place, or takes all of them out."""
    both = F.lower(F.concat_ws("\n", removed, added))
    about = is_coverage_config(path) | both.contains("coverage") | both.contains("threshold") | F.replace(both, F.lit("-"), F.lit("_")).contains("fail_under")
    old, new = limits(removed), limits(added)
    of = lambda own, key: F.transform(F.filter(own, lambda x: x["key"] == key), lambda x: x["value"].cast("double"))
    lower = lambda key: F.exists(F.arrays_zip(of(old, key).alias("a"), of(new, key).alias("b")), lambda z: F.coalesce(z["b"] < z["a"], F.lit(False)))
    return about & (F.exists(F.array(*[F.lit(k) for k in LIMITS]), lower) | ((F.size(old) > 0) & (F.size(new) == 0)))


def _excluded(text: Column) -> Column:
    """How many quoted patterns stand in lists that leave files out of tests or coverage, by the lists' names."""
    lists = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:\w*(?:exclude|ignore)\w*|omit)[\"']?\s*[:=]\s*\[([^\]]*)\]"), F.lit(1))
    return F.aggregate(lists, F.lit(0), lambda n, x: n + F.size(F.filter(F.split(x, ","), lambda y: F.trim(y).rlike("^[\"'`].+[\"'`]$"))))


def adds_exclude(removed: Column, added: Column) -> Column:
    return _excluded(added) > _excluded(removed)


def passes_set(text: Column) -> Column:
    """How often a text lets runs without tests pass, as an option or as a setting."""
    plain = F.replace(F.lower(text), F.lit("-"), F.lit(""))
    return F.regexp_count(plain, F.lit("passwithnotests")) - F.regexp_count(plain, F.lit(r"passwithnotests[\"']?\s*[:=]\s*false"))


def steps_forced(text: Column) -> Column:
    """How many commands are followed by one that always succeeds: || true, || : or || exit 0."""
    behind = F.transform(F.slice(F.split(text, r"\|\|"), 2, F.size(F.split(text, r"\|\|"))), lambda x: F.split(F.trim(x), r"[\s;\"')]+"))
    return F.size(F.filter(behind, lambda w: F.get(w, F.lit(0)).isin("true", ":") | ((F.get(w, F.lit(0)) == "exit") & (F.get(w, F.lit(1)) == "0"))))


def updates_itself(text: Column) -> Column:
    """Whether a configuration lets coverage thresholds follow what was reached."""
    plain = F.regexp_replace(text, r"[\s\"']", "")
    return plain.contains("autoUpdate:") & ~plain.contains("autoUpdate:false")


# -- instructions ------------------------------------------------------------------------------------------------------

_INSTRUCTIONS = (".cursorrules", ".windsurfrules", "agent.md", "agents.md", "claude.local.md", "claude.md", "copilot-instructions.md", "gemini.md", "memory.md")  # files that agents read


def is_instruction_file(path: Column) -> Column:
    name = F.lower(base_name(path))
    return name.isin(*_INSTRUCTIONS) | (name.rlike(r"\.mdc?$") & through(path, ".claude", ".codex", ".cursor"))


_SKIPPING = r"(?:bypass|disabl|ignor|skip)(?:e|es|ed|ing|ping|pes|ped|s)?|turn(?:ing|s)?\s+off"
_CHECKS = r"(?:check|hook|lint|linter|linting|husky|pre-commit|pre-push)s?"
_NOT = ("avoid", "cannot", "can't", "don't", "doesn't", "forbidden", "instead", "mustn't", "never", "not", "rather", "refuse", "shouldn't")


def tells_to_skip(text: Column) -> Column:
    """Whether a line tells to skip checks - by an option, a variable, or a word for skipping up to three words before one for checks - and has no word against it."""

    def line(x: Column) -> Column:
        low = F.lower(x)
        says = low.contains("--no-verify") | x.rlike(r"\b(?:HUSKY|HUSKY_SKIP_HOOKS|SKIP)=\w") | (low.contains("core.hookspath") & low.contains("/dev/null")) | low.rlike(rf"\b(?:{_SKIPPING})(?:\s+[\w-]+){{0,3}}?\s+{_CHECKS}\b")
        words = F.split(F.replace(low, F.lit("’"), F.lit("'")), r"[^\w'-]+")
        return says & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in _NOT])) & ~low.contains("no longer")

    return F.exists(F.split(text, r"\r?\n"), line)
