"""Tool calls as the two channels that rules read, and calls as display shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The caps of a channel and of a shown shape, and the mark of a cut.
CHANNEL_CAP = 8192
SHAPE_CAP = 160
CUT_MARK = "…[truncated]…"
NIL_UUID = "00000000-0000-0000-0000-000000000000"
SHELL_TOOLS = ("Bash", "PowerShell")
FILE_TOOLS = ("Edit", "Write", "Read", "MultiEdit", "NotebookEdit")


def cap_end(text: Column, most: int = CHANNEL_CAP) -> Column:
    return F.substring(text, 1, most)


def cap_middle(text: Column, most: int, mark: str = CUT_MARK) -> Column:
    """A text of at most `most` characters: the head (rounded up), a mark and the tail of a longer one."""
    room = most - len(mark)
    head, rest = (room + 1) // 2, room // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(rest))))


def joined_glob(directory: Column, glob: Column) -> Column:
    """A search's glob under its directory; an absolute glob stands alone, a missing one is the directory."""
    absolute = glob.rlike(r"^(/|[A-Za-z]:[\\/]|\\\\)")
    return F.when(glob.isNull() | (glob == ""), directory).when(directory.isNull() | (directory == "") | absolute, glob).otherwise(F.concat(F.regexp_replace(directory, r"[/\\]+$", ""), F.lit("/"), glob))


def _get(field: str) -> Column:
    return F.get_json_object("input", f"$.{field}")


def map_tool_calls(calls: DataFrame) -> DataFrame:
    """calls (name, input as JSON text) with tool, full_command, raw_path and file_path.

    A shell tool has its command; a file tool its path (a notebook's, if none); a search its glob under its directory; a
    web search its query; a tool of a server its whole input, cut in the middle; any other what it has of both.
    """
    name = F.col("name")
    path = F.coalesce(_get("file_path"), _get("notebook_path"))
    server = name.startswith("mcp__")
    command = (
        F.when(name.isin(*SHELL_TOOLS), cap_end(_get("command")))
        .when(name == "WebSearch", cap_end(_get("query")))
        .when(server, cap_middle(F.col("input"), CHANNEL_CAP))
        .when(name.isin(*FILE_TOOLS, "Grep", "Glob"), F.lit(None).cast("string"))
        .otherwise(cap_end(_get("command")))
    )
    file = (
        F.when(name.isin(*FILE_TOOLS), path)
        .when(name == "Grep", joined_glob(_get("path"), _get("glob")))
        .when(name == "Glob", joined_glob(_get("path"), _get("pattern")))
        .when(server | name.isin(*SHELL_TOOLS, "WebSearch"), F.lit(None).cast("string"))
        .otherwise(path)
    )
    return calls.withColumns({"tool": name, "full_command": command, "raw_path": file}).withColumn("file_path", F.translate("raw_path", "\\", "/"))


def to_spans(mapped: DataFrame) -> DataFrame:
    """Mapped calls as spans: constants where a call has nothing of its own."""
    return mapped.withColumns({
        "kind": F.lit("execute_tool"), "label": F.col("tool"), "detail": F.col("full_command"), "mcp_input": F.lit(None).cast("string"),
        "tokens": F.lit(0).cast("long"), "cached_tokens": F.lit(0).cast("long"), "duration_ms": F.lit(0).cast("long"),
        "agent_id": F.lit(NIL_UUID), "project_id": F.lit(NIL_UUID),
    })


def patch_candidates(text: Column) -> Column:
    """The files that a patch names, one candidate each: array<struct<pos, file_path>>."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+?)\s*$"), 1)
    moved = F.regexp_extract_all(text, F.lit(r"(?m)^\*\*\* Move to: (.+?)\s*$"), 1)
    return F.transform(F.concat(found, moved), lambda p, i: F.struct(i.alias("pos"), p.alias("file_path")))


def shape(text: Column, most: int = SHAPE_CAP) -> Column:
    """What a call looks like, for counting: white space collapsed, cut in the middle."""
    return cap_middle(F.trim(F.regexp_replace(text, r"\s+", " ")), most)


def hidden_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "#")


def sanitized_tool(name: Column, known: tuple[str, ...]) -> Column:
    """A tool's name where it may be shown: unnamed and unusual ones are only said to be so."""
    return F.when(name.isNull() | (F.trim(name) == ""), "<unnamed>").when(name.isin(*known) | name.rlike(r"^[A-Za-z][A-Za-z0-9_]{0,63}$"), name).otherwise("<other>")


def normalized_usage(inputs: Column, cached: Column, written: Column) -> Column:
    """Input tokens without those that were cached or written, 0 at least."""
    zero = F.lit(0)
    return F.greatest(zero, F.coalesce(inputs, zero) - F.coalesce(cached, zero) - F.coalesce(written, zero))


def short_count(n: Column) -> Column:
    """1234 as 1.2K, and so on."""
    one = lambda d, unit: F.concat(F.format_number(F.floor(n / (d / 10)) / 10, 1), F.lit(unit))
    return F.when(n >= 1e9, one(1e9, "B")).when(n >= 1e6, one(1e6, "M")).when(n >= 1e3, one(1e3, "K")).otherwise(n.cast("string"))


# -- edits -----------------------------------------------------------------------------------------------------------

EDITS = "array<struct<path:string,removed:string,added:string,whole:boolean,deleted:boolean>>"


def _edit(path: Column, removed: Column, added: Column, whole: Column, deleted: Column) -> Column:
    return F.struct(path.alias("path"), F.coalesce(removed, F.lit("")).alias("removed"), F.coalesce(added, F.lit("")).alias("added"), whole.alias("whole"), deleted.alias("deleted"))


def patch_edits(patch: Column) -> Column:
    """The edits of a patch text, one a file: lines taken out and put in. A marker counts at a line's start only."""
    sections = F.filter(F.split(F.regexp_replace(patch, "\r\n", "\n"), r"(?m)^(?=\*\*\* (?:Update|Add|Delete) File: )"), lambda s: s.rlike(r"^\*\*\* (?:Update|Add|Delete) File: *\S"))

    def one(section: Column) -> Column:
        mode = F.regexp_extract(section, r"^\*\*\* (Update|Add|Delete) File: (.*)", 1)
        path = F.trim(F.regexp_extract(section, r"^\*\*\* (Update|Add|Delete) File: (.*)", 2))
        body = F.split(F.regexp_replace(section, r"(?s)(?m)^\*\*\* End Patch.*", ""), "\n")
        of = lambda sign: F.array_join(F.transform(F.filter(body, lambda x: x.startswith(sign)), lambda x: F.substr(x, F.lit(2))), "\n")
        return _edit(path, of("-"), of("+"), mode == "Add", mode == "Delete")

    return F.transform(sections, one)


def edits(name: Column, source: Column) -> Column:
    """The edits of a tool call (name, input as JSON text): of Edit, MultiEdit, Write, StrReplace, Delete and apply_patch; none of others."""
    g = lambda f: F.get_json_object(source, f"$.{f}")
    path = F.coalesce(g("file_path"), g("path"), g("notebook_path"))
    parts = F.from_json(g("edits"), "array<struct<old_string:string,new_string:string>>")
    joined = lambda f: F.array_join(F.transform(parts, lambda p: F.coalesce(p[f], F.lit(""))), "\n")
    yes, no, none = F.lit(True), F.lit(False), F.array().cast(EDITS)
    one = lambda *x: F.array(_edit(path, *x)).cast(EDITS)
    found = (
        F.when(name == "apply_patch", patch_edits(F.coalesce(g("input"), g("patch"), g("command"), source)).cast(EDITS))
        .when(F.coalesce(path, F.lit("")) == "", none)
        .when(name.isin("Edit", "StrReplace"), one(g("old_string"), g("new_string"), no, no))
        .when(name == "MultiEdit", one(joined("old_string"), joined("new_string"), no, no))
        .when(name == "Write", one(F.lit(""), F.coalesce(g("content"), g("contents")), yes, no))
        .when(name == "Delete", one(F.lit(""), F.lit(""), no, yes))
    )
    return F.coalesce(found, none)


# -- live payloads -----------------------------------------------------------------------------------------------------

# Event names of one app, by which its payloads are told apart; and its file tools.
CURSOR_EVENTS = ("afterFileEdit", "afterMCPExecution", "afterShellExecution", "beforeMCPExecution", "beforeReadFile", "beforeShellExecution", "beforeSubmitPrompt", "beforeTabFileRead", "postToolUse", "postToolUseFailure", "preToolUse", "stop", "subagentStart")
CURSOR_FILES = ("Delete", "Read", "Write")
CANDIDATES = "array<struct<tool:string,full_command:string,file_path:string>>"


def _kind(payload: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(payload, f"$.{field}", "variant"))


def _text(payload: Column, field: str) -> Column:
    return F.when(_kind(payload, field) == "STRING", F.try_variant_get(payload, f"$.{field}", "string"))


def agent_of(payload: Column) -> Column:
    """cursor, codex or claude: the app that sent a hook payload (a variant); null where none claims it. Asked in this order."""
    event = _text(payload, "hook_event_name")
    cursor = _text(payload, "cursor_version").isNotNull() | F.coalesce(event.isin(*CURSOR_EVENTS), F.lit(False))
    codex = (_text(payload, "turn_id").isNotNull() & _text(payload, "model").isNotNull()) | F.coalesce(_text(payload, "tool_name") == "apply_patch", F.lit(False))
    claude = F.when(event.isNotNull(), event.rlike("^[A-Z]")).otherwise(_text(payload, "tool_name").isNotNull() | F.coalesce(_kind(payload, "tool_input").startswith("OBJECT"), F.lit(False)))
    return F.when(F.coalesce(F.schema_of_variant(payload).startswith("OBJECT"), F.lit(False)), F.when(cursor, "cursor").when(codex, "codex").when(claude, "claude"))


def cursor_candidates(payload: Column) -> Column:
    """The calls to evaluate for a payload of the cursor app, strictest to win; null for events that are not checked."""
    event, tool = _text(payload, "hook_event_name"), F.coalesce(_text(payload, "tool_name"), F.lit(""))
    given = lambda f: _text(payload, f"tool_input.{f}")
    none = F.lit(None).cast("string")
    call = lambda name, command=none, path=none: F.struct(name.alias("tool"), command.alias("full_command"), path.alias("file_path"))
    glob, folder = F.nullif(given("glob"), F.lit("")), F.nullif(given("file_path"), F.lit(""))
    alone = glob.isNotNull() & (folder.isNull() | glob.rlike(r"^(?:/|[A-Za-z]:[\\/]|\\\\)"))
    search = F.when(alone, F.array(call(F.lit("Grep"), none, glob))).when(folder.isNull(), F.array(call(F.lit("Grep")))).when(glob.isNull(), F.array(call(F.lit("Grep"), none, folder)))
    search = search.otherwise(F.array(call(F.lit("Grep"), none, joined_glob(folder, glob)), call(F.lit("Grep"), none, folder)))
    raw = F.coalesce(_text(payload, "tool_input"), F.to_json(F.try_variant_get(payload, "$.tool_input", "variant")), F.lit("{}"))
    used = (
        F.when(tool == "Shell", F.array(call(F.lit("Bash"), cap_end(given("command")))))
        .when(tool.isin(*CURSOR_FILES), F.array(call(tool, none, given("file_path"))))
        .when(tool == "Grep", search)
        .when(tool.startswith("MCP:"), F.array(call(F.concat(F.lit("mcp__cursor__"), F.substr(tool, F.lit(5))), cap_middle(raw, CHANNEL_CAP))))
        .otherwise(F.array(call(tool, cap_end(given("command")), given("file_path"))))
    )
    return F.when(event == "beforeShellExecution", F.array(call(F.lit("Bash"), cap_end(_text(payload, "command"))))).when(event == "preToolUse", used).cast(CANDIDATES)


# -- what a file may be shown as ----------------------------------------------------------------------------------------

# The kind of file that each shipped rule on paths is about.
FILE_KINDS = {
    "ac.instruction-file-edit": "agent instructions file", "ac.mcp-server-add": "MCP config file", "ac.memory-store-edit": "agent memory file", "ac.skill-install": "agent skill file", "block-env-file-read": "env file",
    "block-prod-config-edit": "production config", "fs.agent-self-config": "agent settings file", "fs.ci-definition": "CI workflow", "fs.system-paths": "system file", "fs.vcs-internals": "git internals file",
    "require-auth-on-pii-endpoints": "API route file", "se.credential-file": "credentials file", "ti.test-config-edit": "test config",
}
WELL_KNOWN = (".mcp.json", "AGENTS.md", "CLAUDE.local.md", "CLAUDE.md", "GEMINI.md", "MEMORY.md", "package.json", "tsconfig.json")
STAGES = ("ci", "dev", "development", "example", "local", "prod", "production", "sample", "staging", "template", "test")  # what follows .env


def well_known(name: Column) -> Column:
    """Whether a file's name says nothing of its project: it is the same in all that have such a file."""
    parts = F.split(name, r"\.")
    tool = F.get(parts, F.lit(0)).isin("jest", "vite", "vitest") & F.get(parts, F.lit(1)).isin("config", "workspace") & (F.size(parts) == 3) & F.get(parts, F.lit(2)).rlike("^(?:json|[cm]?[jt]s)$")
    env = name.startswith(".env") & (F.get(parts, F.lit(1)) == "env") & F.forall(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), lambda x: x.isin(*STAGES))
    return F.coalesce(name.isin(*WELL_KNOWN) | tool | env, F.lit(False))


def file_shape(tool: Column, path: Column, rule_id: Column) -> Column:
    """A file call as it may be shown: the tool, and a well-known name or the kind of file that the rule is about."""
    workflow = F.regexp_extract(F.trim(path), r"(?:^|[\\/])\.github[\\/]workflows[\\/][^\\/]+\.(yml|yaml)$", 1)
    last = F.regexp_extract(F.trim(path), r"[^\\/]*$", 0)
    kinds = F.create_map(*[F.lit(x) for kv in FILE_KINDS.items() for x in kv])
    name = F.when(workflow != "", F.concat(F.lit(".github/workflows/<file>."), workflow)).when(well_known(last), last).otherwise(F.concat(F.lit("<"), F.coalesce(kinds[rule_id], F.lit("file")), F.lit(">")))
    return F.concat(F.when(tool.rlike("^[A-Za-z][A-Za-z0-9_]{0,40}$"), tool).otherwise("File tool"), F.lit(" "), name)


def texts_of(calls: DataFrame) -> DataFrame:
    """The texts of calls (session_key, call_order, name, input, content) with how each came in: command, edit, input or output."""
    command = F.when(F.col("name").isin(*SHELL_TOOLS), _get("command"))
    written = F.transform(edits(F.col("name"), F.col("input")), lambda e: F.struct(e["added"].alias("text"), F.lit("edit").alias("via")))
    rest = F.when(command.isNull() & (F.size(written) == 0), F.col("input"))
    one = lambda text, via: F.struct(text.alias("text"), F.lit(via).alias("via"))
    all_ = F.concat(F.array(one(command, "command"), one(rest, "input"), one(F.col("content"), "output")), written)
    return calls.select("session_key", "call_order", F.explode(all_).alias("t")).select("session_key", "call_order", "t.text", "t.via").where("coalesce(text, '') <> ''")


def stringified(value: Column) -> Column:
    """JSON text in one spelling: no blanks between its parts, keys in order."""
    return F.to_json(F.try_parse_json(value))


def display_shape(tool: Column, text: Column, most: int = SHAPE_CAP) -> Column:
    """What a call looks like in a report: a server's payload without its values, any other text redacted; then collapsed and cut."""
    from ..functions import redact

    server = tool.startswith("mcp__")
    hidden = F.when(server, redact.payload(F.when(server, text))).otherwise(redact.for_report(F.when(~server, text)))
    return shape(hidden, most)
