"""Redaction: native expressions for single patterns and paths, Arrow functions for the ordered scrub and for a command's operands.

A report's text is scrubbed by value, then by structure (paths), then by name (secrets), then by place in a command
(identifiers), in this order: each pass leaves the marks of those before it alone. Rows without a cheap marker of
any pattern are settled natively and never reach Python.
"""

from __future__ import annotations

import json
import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels, shell


def emails(text: Column) -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")


_RUN = r"[^\s'\"\[\]<>|&;()$=]"
_PATH = rf"(?<!{_RUN})(?:(?:\.\.?|~|[A-Za-z]:)(?!{_RUN})|{_RUN}*[/\\]{_RUN}*)"


def paths(text: Column) -> Column:
    """Words that are paths become <path>: any with a slash or backslash, ., .., ~ and a bare drive; a quoted region that holds one as a whole.

    A quoted region with a placeholder in it keeps that; only the words in it that are paths go.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"'[^']*'|\"[^\"]*\"|[^'\"]+|['\"]"), F.lit(0))
    whole = lambda p: (F.length(p) > 2) & (p.startswith("'") | p.startswith('"')) & p.rlike(_PATH) & ~p.rlike(r"<[a-z][a-z-]*>")
    kept = F.transform(pieces, lambda p: F.when(whole(p), F.concat(F.substring(p, 1, 1), F.lit("<path>"), F.substring(p, 1, 1))).otherwise(p))
    return F.when(text.isNotNull(), F.regexp_replace(F.array_join(kept, ""), _PATH, "<path>"))


def fingerprint(value: Column, salt: str) -> Column:
    """A value's keyed digest: equal within one run's salt, and of no use outside."""
    return F.sha2(F.concat(F.lit(salt), F.lit("\u0000"), value), 256)


def is_placeholder(value: Column) -> Column:
    """Whether a value only stands for a secret."""
    return value.rlike(r"(?i)^(?:[*x.]+|<[^>]*>|\$\{?\w+\}?|(?:your|my|the|some)[-_ ].*|.*(?:example|placeholder|changeme|change-me|dummy|redacted|todo|insert).*|test|secret|password|null|none|true|false)$")


def is_local_value(value: Column) -> Column:
    """Whether a value is a credential for a service on this machine."""
    return value.rlike(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^@/?#\s]*@)?(?:localhost|127(?:\.\d{1,3}){3}|0\.0\.0\.0|\[?::1\]?|host\.docker\.internal)(?:[:/?#]|$)")


def luhn(digits: str) -> bool:
    """Whether 13 to 19 digits carry a valid check digit."""
    if not 13 <= len(digits) <= 19 or not digits.isdigit():
        return False
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def card_number(text: Column) -> Column:
    """Whether a text's digits are a card number's."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text))) if n else 0.0


def looks_random(text: str) -> bool:
    """Whether a token of 32 characters or more looks generated: mixed, of high entropy, no id or name of a known shape."""
    if len(text) < 32 or not re.search(r"[A-Za-z]", text) or not re.search(r"\d", text):
        return False
    if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]+|sha\d+[-:].*", text) or re.search(r"\d{8,}", text):
        return False
    parts = [p for p in re.split(r"[-_./]", text) if p]
    if len(parts) > 2 and all(re.fullmatch(r"[a-z]+|[A-Z]+|\d{1,4}", p) for p in parts):
        return False
    worded = sum(len(w) for w in re.findall(r"[A-Z]?[a-z]{4,}", text))
    return worded < 0.7 * len(text) and entropy(text) >= 4


def _accept_all(_: re.Match) -> bool:
    return True


_CLIENT = re.compile(r"(?:mysql\w*|mariadb[\w-]*)", re.IGNORECASE)  # programs whose password is glued to -p
_INNER = {  # programs that run another one behind these words, and the options of theirs that take a value
    **dict.fromkeys(("docker", "docker-compose", "nerdctl", "podman", "podman-compose"), "-e -u -v -w -p -f --entrypoint --env --env-file --file --hostname --name --network --platform --publish --user --volume --workdir"),
    **dict.fromkeys(("kubectl", "oc"), "-c -f -n --container --context --filename --image --kubeconfig --namespace"),
}


def _runs_client(words: list[str]) -> bool:
    """Whether the program of a simple command, or the one that it runs in a container or on a host, is a client that takes its password glued to -p."""
    while words and (re.fullmatch(r"[-*$%>#]|[\w.-]+:", words[0]) or "=" in words[0]):  # a list's or prompt's sign, a key, an assignment
        words = words[1:]
    seg = shell.Segment([shell.Word(w, 0, 0) for w in words])
    name, rest = seg.name, [w.text for w in seg.args]
    if _CLIENT.fullmatch(name):
        return True
    if name == "ssh":
        args = labels.Args(rest, labels.SSH)
        return _runs_client(" ".join(args.operands[1:]).split())
    verb = next((i for i, w in enumerate(rest) if w in ("exec", "run")), None) if name in _INNER else None
    if verb is None:
        return False
    k, named, valued = verb + 1, False, _INNER[name].split()
    while k < len(rest):
        w = rest[k]
        if w == "--":
            return _runs_client(rest[k + 1 :])
        if w.startswith("-"):
            k += 2 if w in valued else 1
        elif not named:  # the container, image or pod
            k, named = k + 1, True
        else:
            return _runs_client(rest[k:])
    return False


def _client_password(m: re.Match) -> bool:
    """Whether what follows -p is a client's password, as a shell would read the statement before it; where its quotes don't close, yes."""
    before = m.string[max(0, m.start() - 512) : m.start()]
    if not _CLIENT.search(before[-210:]):
        return False
    statement = re.split(r"(?<!\\)\n", before)[-1]
    if array := re.search(r"\[\s*((?:\"[^\"\n]*\"\s*,\s*)+)\"$", statement):  # a command as an array of its words
        return _runs_client(re.findall(r'"([^"\n]*)"', array[1]))
    read = shell.parse(statement + m[0])
    if read.unterminated:
        return True
    words = [w.text for w in read.segments[-1].words] if read.segments else []
    return bool(words) and words[-1].startswith("-p") and _runs_client(words[:-1])


# The patterns' names and their order, in which a hit hides its text from those that follow. Where a pattern
# has a group v, only that is replaced.
PATTERNS: list[tuple[str, re.Pattern, str, object]] = [
    (name, re.compile(pattern), shown, accept)
    for name, pattern, shown, accept in (
        ("aws-access-key-id", r"\b(?:AKIA|ABIA|ACCA|AGPA|AIDA|AIPA|ANPA|ANVA|AROA|ASCA|ASIA)[0-9A-Z]{16}\b", "<aws-access-key-id>", _accept_all),
        ("pem-private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", "<private-key>", _accept_all),
        ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", "<jwt>", _accept_all),
        ("github-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})", "<github-token>", _accept_all),
        ("slack-token", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", "<slack-token>", _accept_all),
        ("openai-key", r"\bsk-[A-Za-z0-9_-]{20,}", "<api-key>", _accept_all),
        ("connection-string", r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s'\"]+", "<connection-string>", _accept_all),
        ("basic-auth-url", r"\bhttps?://[^\s/:@'\"]+:[^\s/@'\"]+@[^\s'\"]*", "<url-with-credentials>", _accept_all),
        ("bearer-token", r"(?i)\bbearer\s+(?P<v>[A-Za-z0-9._~+/=-]{8,})", "<token>", _accept_all),
        ("aws-secret-access-key", r"(?i)\baws_?secret_?access_?key\s*[=:]\s*['\"]?(?P<v>[A-Za-z0-9/+=]{40})['\"]?", "<aws-secret-access-key>", _accept_all),
        ("env-secret", r"\b[A-Z][A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|API_?KEY|PRIVATE_KEY)[A-Z0-9_]*=(?:'(?P<v>[^'\n]*)'|\"(?P<w>[^\"\n]*)\"|(?P<x>[^\s'\"]+))", "<env-secret>", _accept_all),
        ("key-name-secret", r"(?i)\b(?:api[_-]?key|secret|token|password|passwd|pwd)\b['\"]?\s*[:=]\s*(?:'(?P<v>[^'\n]{4,})'|\"(?P<w>[^\"\n]{4,})\"|(?P<x>[^\s'\",;]{6,}))", "<secret>", _accept_all),
        ("authorization-header", r"(?i)\bauthorization\s*:\s*(?P<v>[^\n'\"]+)", "<value>", _accept_all),
        ("mysql-password-flag", r"(?<![\w-])-p(?!ort\b|rotocol\b)(?P<v>'[^'\n]+'|\"[^\"\n]+\"|[^\s'\"|;&)\],]+)", "<password>", lambda m: _client_password(m)),
        ("cloud-account-id", r"\barn:aws[a-z-]*:[a-z0-9-]*:[a-z0-9-]*:(?P<v>\d{12})\b|(?i:\b(?:account|owner)[ _-]?(?:id)?['\"]?\s*[=:]\s*['\"]?)(?P<w>\d{12})\b", "<cloud-account>", _accept_all),
        ("generic-secret", r"[A-Za-z0-9_+/=.-]{32,}", "<random>", lambda m: looks_random(m[0])),
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>", _accept_all),
        ("ssn", r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}\b", "<ssn>", _accept_all),
        ("credit-card", r"\b\d(?:[ -]?\d){12,18}\b", "<credit-card>", lambda m: luhn(re.sub(r"\D", "", m[0]))),
    )
]

#: What a text must hold for any pattern to hit: rows without it need no Python.
MARKERS = r"(?i)@|://|-----BEGIN|A(?:KIA|BIA|CCA|GPA|IDA|IPA|NPA|NVA|ROA|SCA|SIA)[0-9A-Z]{16}|eyJ|gh[pousr]_|github_pat_|xox|sk-|bearer|secret|token|passw|pwd|key|authorization|mysql|mariadb|arn:aws|account|owner|[A-Za-z0-9_+/=.-]{32}|\d(?:[ -]?\d){8}"


#: Texts, in lower case, of which a pattern's hit holds one. Patterns that name none stand with a test of their own.
ANCHORS: dict[str, tuple[str, ...]] = {
    "aws-access-key-id": ("abia", "acca", "agpa", "aida", "aipa", "akia", "anpa", "anva", "aroa", "asca", "asia"), "pem-private-key": ("-----begin",), "jwt": ("eyj",), "github-token": ("gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_"),
    "slack-token": ("xox",), "openai-key": ("sk-",), "connection-string": ("://",), "basic-auth-url": ("://",), "bearer-token": ("bearer",), "aws-secret-access-key": ("access",), "env-secret": ("key", "passw", "secret", "token"),
    "key-name-secret": ("key", "passw", "pwd", "secret", "token"), "authorization-header": ("authorization",), "mysql-password-flag": ("mariadb", "mysql"), "cloud-account-id": ("account", "arn:aws", "owner"), "email": ("@",),
}
_FOLDED = str.maketrans({"ſ": "s", "K": "k", "İ": "i", "ı": "i"})  # letters that patterns without case take for others
_NO_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)


def _automaton() -> ahocorasick.Automaton:
    by: dict[str, list[str]] = {}
    for name, anchors in ANCHORS.items():
        for a in anchors:
            by.setdefault(a, []).append(name)
    out = ahocorasick.Automaton()
    for a, names in by.items():
        out.add_word(a, tuple(names))
    out.make_automaton()
    return out


_SCAN = _automaton()


def possible(text: str) -> set[str]:
    """The patterns that can hit a text, out of one scan for all anchors. Hits only take text away, so none is added by those before."""
    found: set[str] = set()
    for _, names in _SCAN.iter(text.translate(_FOLDED).lower()):
        found.update(names)
    digits = len(text.encode("utf-8", "replace").translate(None, _NO_DIGITS))
    if digits >= 9 or not text.isascii():
        found.add("ssn")
    if digits >= 13 or not text.isascii():
        found.add("credit-card")
    if any(len(w) >= 32 for w in text.split()):
        found.add("generic-secret")
    return found


def _signs(text: str) -> tuple[str, str]:
    """A delimiter and sixteen digits that text doesn't hold, of those that Unicode leaves to private use."""
    used, out = set(text), []
    for start, stop in ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)):
        for c in map(chr, range(start, stop)):
            if c not in used:
                out.append(c)
                if len(out) == 17:
                    return out[0], "".join(out[1:])
    raise ValueError("the text holds every private-use character")


def _scrub(text: str, found: list | None = None) -> tuple[str, dict[str, int]]:
    mark, digits = _signs(text)
    slots: list[str] = []
    counts: dict[str, int] = {}

    def slot(shown: str) -> str:
        slots.append(shown)
        return mark + "".join(digits[int(c, 16)] for c in f"{len(slots) - 1:x}") + mark

    can = possible(text)
    for name, pattern, shown, accept in PATTERNS:
        if name not in can:
            continue

        def put(m: re.Match, name=name, shown=shown, accept=accept) -> str:
            if not accept(m):
                return m[0]
            counts[name] = counts.get(name, 0) + 1
            part = next((g for g in ("v", "w", "x") if g in m.re.groupindex and m[g] is not None), 0)
            if found is not None and mark not in m[part]:
                found.append({"kind": name, "value": m[part]})
            return m[0][: m.start(part) - m.start()] + slot(shown) + m[0][m.end(part) - m.start() :]

        text = pattern.sub(put, text)
    back = {c: f"{i:x}" for i, c in enumerate(digits)}
    return re.sub(f"{mark}([{digits}]+){mark}", lambda m: slots[int("".join(back[c] for c in m[1]), 16)], text), counts


def scrub_text(text: str) -> tuple[str, dict[str, int]]:
    """text with every hit replaced, and hits by pattern. A hit becomes a slot of signs that no later pattern can read."""
    return _scrub(text)


def _column(column: str | Column) -> Column:
    return column if isinstance(column, Column) else F.col(column)


def scrub(column: str | Column) -> Column:
    """struct<text, counts>: the ordered scrub of a column; null stays null, with no counts."""

    def run(texts: pa.Array) -> pa.Array:
        done = [scrub_text(t) if t is not None else (None, {}) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([list(c.items()) for _, c in done], pa.map_(pa.string(), pa.int32()))], ["text", "counts"])

    c = _column(column)
    r = F.arrow_udf(run, "text string, counts map<string,int>")(F.when(c.rlike(MARKERS), c))
    return F.struct(F.coalesce(r["text"], c).alias("text"), r["counts"].alias("counts"))


def found(column: str | Column) -> Column:
    """array<struct<kind, value>> of what the scrub replaces."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            own: list[dict] = []
            if t is not None:
                _scrub(t, own)
            out.append(own)
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))

    c = _column(column)
    return F.arrow_udf(run, "array<struct<kind: string, value: string>>")(F.when(c.rlike(MARKERS), c))


# -- secrets by name, identifiers by place --------------------------------------------------------------------------

_VALUE = r"[^\s\"',;\[<]"


def secrets(text: Column) -> Column:
    """Values that a name ending in key, or an authorization scheme, gives away."""
    named = rf"(?i)(?<![A-Za-z0-9_-])([A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)*[_-]key[\"']?\s*[=:]\s*)(?:\"(?!<)[^\"]{{4,}}\"|'(?!<)[^']{{4,}}'|{_VALUE}{{4,}})"
    scheme = rf"(?i)(?<![A-Za-z0-9_-])(authorization[\"']?\s*[=:]\s*[\"']?(?:(?:Basic|Token|Digest|Negotiate|ApiKey|Api-Key)\s+)?)(?!Bearer\s|<){_VALUE}{{8,}}"
    return F.regexp_replace(F.regexp_replace(text, named, "$1<secret>"), scheme, "$1<value>")


#: Programs whose operands name something of their user's, by family.
FAMILIES = {
    "container": ("docker", "docker-compose", "nerdctl", "podman", "podman-compose"), "kube": ("kubectl",), "ssh": ("scp", "sftp", "ssh"), "git": ("git",), "op": ("op",), "gh": ("gh",),
    "db": ("createdb", "dropdb", "mariadb", "mongo", "mongosh", "mysql", "mysqladmin", "mysqldump", "pg_dump", "pg_isready", "pg_restore", "psql", "redis-cli"), "cloudflare": ("wrangler",), "gcp": ("bq", "firebase", "gcloud", "gsutil"),
}
# Words that are a program's own, by its manual: commands and kinds of things, in the manual's groups.
_DOCKER = (
    "run exec ps build pull push images login logout search version info",  # common commands
    "builder buildx checkpoint compose container context image manifest network plugin system trust volume",  # management
    "swarm config node secret service stack",  # swarms
    "attach commit cp create diff events export history import inspect kill load logs pause port rename restart rm rmi save start stats stop tag top unpause update wait",  # commands
    "convert down init list ls prune scale up watch",  # of compose and of the groups above
)
_KUBECTL = (
    "create expose run set explain get edit delete rollout scale autoscale certificate cluster-info top cordon uncordon drain taint describe logs attach exec port-forward proxy cp auth debug diff apply patch replace wait kustomize label annotate completion alpha api-resources api-versions config plugin version",
    "all configmap configmaps cm context contexts cronjob cronjobs crd daemonset daemonsets deploy deployment deployments endpoints event events hpa ingress ingresses job jobs namespace namespaces ns node nodes pod pods pv pvc replicaset replicasets secret secrets service services serviceaccount statefulset statefulsets svc",
    "clusterrole clusterrolebinding role rolebinding",
)
_OP = (
    "account connect document events-api group item plugin service-account user vault",  # what there is
    "add confirm create delete edit forget get grant init list ls move provision reactivate remove revoke rm share suspend template",  # what is done with it
    "completion inject read run signin signout update whoami",
)
VERBS = {family: frozenset(" ".join(groups).split()) for family, groups in (("container", _DOCKER), ("kube", _KUBECTL), ("op", _OP))}
# What stands for an option's value; None where it may be shown.
_HOSTS, _DATABASES, _STATEMENTS = ("-h", "--host"), ("-d", "-D", "--database", "--dbname"), ("-c", "-e", "--command", "--eval", "--execute")
OPTIONS = {
    "kube": dict.fromkeys(("-n", "--namespace"), "<name>"), "op": {**dict.fromkeys(("--account", "--vault"), "<name>"), **dict.fromkeys(("--field", "--fields", "--format"))},
    "db": {**dict.fromkeys(_HOSTS, "<host>"), **dict.fromkeys((*_DATABASES, *_STATEMENTS), "<name>")},
    "ssh": {**dict.fromkeys(labels.SSH.split()), "-P": None, "-l": "<user>", "-J": "<host>"},
    "git": dict.fromkeys(("-C", "-c", "--exec-path", "--git-dir", "--work-tree")), "gh": dict.fromkeys(("-b", "-n", "-t", "--body", "--notes", "--title"), "<message>"), "gcp": dict.fromkeys(("--project", "--project-id", "--project_id"), "<name>"),
}
MESSAGES = ("am", "cherry-pick", "commit", "merge", "notes", "revert", "stash", "tag")  # verbs of git whose -m is a message
SECRET_OPTION = re.compile(r"--?(?:[a-z0-9]+-)*(?:token|password|passwd|secret|api-?key|access-?key|auth)$", re.IGNORECASE)
UUID = re.compile(r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", re.IGNORECASE)


def _operand(family: str, program: str, word: str, seen: list[str], prose: bool) -> str | None:
    """What stands for an operand that is no option, given those before it; None where it may be shown."""
    if family in ("container", "op"):
        inner = next((i for i, x in enumerate(seen) if family == "container" and x in ("exec", "run")), None)
        if inner is not None and any(x not in VERBS[family] for x in seen[inner:]):
            return None  # the command that runs inside
        return None if word in VERBS[family] else "<name>"
    if family == "kube":
        return None if prose or word in VERBS["kube"] else "<name>"
    if family == "ssh":
        if re.fullmatch(r"[^@\s]+@[^@\s]+", word):
            return "<user>@<host>"
        return "<host>" if not seen and program != "scp" else None
    if family == "cloudflare" and re.fullmatch(r"(?i)[0-9a-f]{32}", word):
        return "<name>"
    return None


def _segment_edits(words: list, prose: bool) -> list[tuple[int, int, str]]:
    """What to put for words of a simple command (start, stop, text)."""
    edits, family, program, seen, pending = [], "", "", [], ""
    known = {p: f for f, own in FAMILIES.items() for p in own}
    for w in words:
        text = w.text
        if pending is not None and pending != "" and not text.startswith("-"):
            if pending != "keep" and not re.fullmatch(r"<[a-z-]+>", text):
                shown = re.sub("=.*", "=<user>", text) if pending == "identity" and re.match(r"user\.(?:name|email)=", text) else pending
                if shown not in ("identity",):
                    edits.append((w.start, w.stop, shown))
            pending = ""
            continue
        pending = ""
        option, glued, _ = text.partition("=")
        if glued and SECRET_OPTION.match(option):
            edits.append((w.start, w.stop, f"{option}=<secret>"))
        elif not glued and SECRET_OPTION.match(text):
            pending = "<secret>"
        elif text in known and text not in seen:
            family, program, seen = known[text], text, []
        elif re.fullmatch(r"<[a-z-]+>", text):
            seen.append(text)
        elif not family:
            pass
        elif text.startswith("-"):
            verb = seen[0] if seen else ""
            table = OPTIONS.get(family, {})
            if family == "git" and verb in MESSAGES and re.fullmatch(r"-[A-Za-z]*m|--message", option):
                if glued:
                    edits.append((w.start, w.stop, "--message=<message>"))
                else:
                    pending = "<message>"
            elif option in table:
                shown = table[option]
                if not glued:
                    pending = shown or ("identity" if family == "git" and text == "-c" and not seen else "keep")
                elif shown:
                    edits.append((w.start, w.stop, f"{option}={shown}"))
            elif family == "container" and glued:
                edits.append((w.start, w.stop, f"{option}=<name>"))
        elif glued and family == "container":
            edits.append((w.start, w.stop, f"{option}=<name>"))
        elif family == "git" and seen[:1] == ["config"] and text in ("user.name", "user.email"):
            pending = "<user>"
        else:
            if (shown := _operand(family, program, text, seen, prose)) is not None:
                edits.append((w.start, w.stop, shown))
            seen.append(text)
    return edits


def identifiers_text(text: str, prose: bool = False) -> str:
    """A command's text without the names of hosts, containers, databases, people and messages in it. prose: a title, whose words are no operands."""
    from .shell import parse

    p, edits = parse(text), []
    for s in p.segments:
        edits += _segment_edits(s.words, prose)
        edits += [(a, max(a, b - 1), "<message>") for a, b, _ in s.heredocs if b > a]
    if not prose:
        edits += [(a, b, "#<comment>") for a, b in p.comments if text[a + 1 : b].strip()]
    at, out = 0, []
    for a, b, shown in sorted(edits):
        if a >= at:
            quote = text[a] if text[a] in "'\"" and text[b - 1 : b] == text[a] and b - a > 1 else ""
            out += [text[at:a], quote, shown, quote]
            at = b
    return UUID.sub("<name>", "".join(out) + text[at:])


def _identifiers(prose: bool):
    return F.arrow_udf(lambda texts: pa.array([None if t is None else identifiers_text(t, prose) for t in texts.to_pylist()], pa.string()), "string")


def for_report(column: str | Column) -> Column:
    """A command's text as a report may show it."""
    return _identifiers(False)(secrets(paths(scrub(column)["text"])))


def title_for_report(column: str | Column) -> Column:
    """A rule's title as a report may show it: as for_report, but words with slashes and plain nouns stay."""
    return _identifiers(True)(secrets(scrub(column)["text"]))


def _hidden(value):
    if isinstance(value, dict):
        return {k: _hidden(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_hidden(v) for v in value]
    return value if value is None or isinstance(value, bool) else "<value>"


def payload(column: str | Column) -> Column:
    """A JSON payload of any depth with its strings and numbers hidden; what is no JSON is scrubbed as text."""

    def one(t: str) -> str:
        try:
            return json.dumps(_hidden(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return scrub_text(t)[0]

    return F.arrow_udf(lambda texts: pa.array([one(t) if t is not None else None for t in texts.to_pylist()], pa.string()), "string")(_column(column))
