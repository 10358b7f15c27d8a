"""Scalar functions as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a code query.
STOP_WORDS = ["the", "and", "for", "with", "are", "was", "this", "that", "from", "into", "have", "has", "not", "you", "can", "will", "how", "what", "but", "its", "all", "any"]

# File rules.
ALLOWED_EXTENSIONS = ["go", "php"]
IGNORED_DIRS = ["vendor", "node_modules", "mock", "fixture"]
IGNORED_FILES = [r"_test\.go$"]


def truncate(s: Column, n: int) -> Column:
    """At most n code points, with an ellipsis where some were cut."""
    if n <= 0:
        return F.lit("")
    return F.when(F.char_length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("..."))).otherwise(s)


def token_estimate(s: Column) -> Column:
    """One token for each non-ASCII code point, one for every four ASCII ones begun."""
    ascii_chars = F.length(F.regexp_replace(s, r"[^\x00-\x7F]", ""))
    return (F.length(s) - ascii_chars + F.floor((ascii_chars + 3) / 4)).cast("long")


def query_terms(s: Column) -> Column:
    """Distinct terms in order: English words of three characters or more less stop words, then Han bigrams (a lone character as it is)."""
    words = F.filter(F.transform(F.regexp_extract_all(s, F.lit("([A-Za-z][A-Za-z0-9_]{2,})"), 1), lambda w: F.lower(w)), lambda w: ~w.isin(STOP_WORDS))
    runs = F.regexp_extract_all(s, F.lit(r"(\p{IsHan}+)"), 1)
    pairs = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))),
        )
    )
    return F.array_distinct(F.concat(words, pairs))


def module_of_path(path: Column) -> Column:
    """The first path segment that is not blank, or 'default'."""
    parts = F.filter(F.split(path, "/"), lambda p: F.trim(p) != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("default"))


def import_module(path: Column) -> Column:
    """The last segment of an import path, one closing slash aside."""
    return F.element_at(F.split(F.regexp_replace(path, "/$", ""), "/"), -1)


def selector_alias(call: Column) -> Column:
    return F.substring_index(call, ".", 1)


def selector_rest(call: Column) -> Column:
    at = F.instr(call, ".")
    return F.when(at > 0, F.substring(call, at + 1, F.length(call))).otherwise("")


def function_key(module: Column, func: Column) -> Column:
    return F.concat_ws(".", module, func)


def normalize_url(url: Column) -> Column:
    """A repository URL without scheme, user, suffix or closing slash, so that ssh and https forms agree."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "/$", ""), r"\.git$", "")
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "^https://", ""), "^http://", ""), "^ssh://", "")
    return F.regexp_replace(F.regexp_replace(u, "^git@", ""), "^([^:]*):", "$1/")


def webhook_task_id(url: Column, branch: Column, commit: Column) -> Column:
    return F.concat(F.lit("webhook-"), F.left(F.sha1(F.concat_ws("|", url, branch, commit).cast("binary")), F.lit(16)))


def extension(path: Column) -> Column:
    """Lower-case suffix without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))


def csv_list(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns), F.lit(""))


def is_tag(ref: Column) -> Column:
    return ref.startswith("refs/tags/")


def branch_of(ref: Column) -> Column:
    return F.regexp_replace(ref, "^refs/(heads|tags)/", "")


def is_deletion(commit: Column) -> Column:
    return commit.rlike("^0+$")


def line_of(s: Column, offset: Column) -> Column:
    """The line, from 1, of a place counted in code points from 0; out of range is line 1."""
    inside = (offset >= 0) & (offset <= F.length(s))
    return F.when(inside, 1 + F.regexp_count(F.substring(s, F.lit(1), offset), F.lit("\n"))).otherwise(1).cast("long")


def embedding_text(*fields: Column) -> Column:
    return F.concat_ws("\n", *fields)


def safe_int(s: Column) -> Column:
    return F.coalesce(s.try_cast("long"), F.lit(0).cast("long"))


def leading_int(s: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^(\d+)", 1), F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def json_object(s: Column) -> Column:
    """What a model wrapped in a code fence or in prose: from the first brace to the last one, or empty."""
    fence = F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(fence != "", fence).otherwise(s)
    return F.regexp_extract(inner, r"(?s)(\{.*\})", 1)


def dependency_json(s: Column) -> Column:
    """A JSON array as it is, any other text as an array of itself, blank as an empty array."""
    parsed = F.from_json(s, "array<string>")
    return F.when(F.trim(F.coalesce(s, F.lit(""))) == "", F.lit("[]")).when(s.rlike(r"^\s*\["), F.to_json(F.coalesce(parsed, F.array()))).otherwise(F.to_json(F.array(s)))


def average_price(price_in: Column, price_out: Column) -> Column:
    return (price_in + price_out) / 2


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1000, 6)


def error_class(status: Column, kind: Column) -> Column:
    """retriable, auth or business; what is not known may be tried again."""
    return (
        F.when(kind.isin("timeout", "network", "rate_limit"), "retriable")
        .when(status.isin(401, 403), "auth")
        .when(status == 429, "retriable")
        .when(status >= 500, "retriable")
        .when((status >= 400) & (status < 500), "business")
        .otherwise("retriable")
    )


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def version_default(version: Column, branch: Column, day: Column) -> Column:
    # fixed value: the prefix of an unnamed version
    return F.coalesce(F.nullif(F.trim(version), F.lit("")), F.nullif(F.trim(branch), F.lit("")), F.concat(F.lit("迭代-"), F.date_format(day, "yyyyMMdd")))


def impact_tokens(n: Column) -> Column:
    return 600 + 300 * F.greatest(n, F.lit(1))


def safe_path(path: Column) -> Column:
    """Is a relative path inside its root?  Absolute paths and paths that climb out are not."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, p: F.struct(
            (s["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"),
            F.least(s["low"], s["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("low"),
        ),
    )
    return ~path.startswith("/") & (depth["low"] >= 0)


def page_count(total: Column, size: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(total / size))


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text in lower-case hex, of two hashes that Spark has."""
    inner, outer = hmac_pads(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def expand_placeholders(s: Column, values: dict[str, str], most: int = 5) -> Column:
    """The first ``most`` placeholders ${X} replaced by values, unknown ones by nothing; an open one stays."""
    known = F.create_map(*(F.lit(x) for kv in (values or {"": ""}).items() for x in kv))
    whole = r"(?s)^(.*?)\$\{([^}]*)\}(.*)$"
    for _ in range(most):
        value = F.coalesce(F.try_element_at(known, F.regexp_extract(s, whole, 2)), F.lit(""))
        s = F.when(s.rlike(whole), F.concat(F.regexp_extract(s, whole, 1), value, F.regexp_extract(s, whole, 3))).otherwise(s)
    return s


def random_id() -> Column:
    """32 random hex digits."""
    return F.replace(F.uuid(), F.lit("-"))


_REPOSITORY = "struct<url: string, git_http_url: string, git_ssh_url: string, html_url: string>"
_PUSH = f"object_kind string, hook_name string, ref string, before string, after string, repository {_REPOSITORY}, project {_REPOSITORY}, unread string"


def push_event(body: Column) -> Column:
    """provider, repo_url, branch, tag, deleted, before, after and error of a push payload, as the two providers send it.

    error says what is missing: body, json, event, url or branch; empty if the event can be used.
    The payload is parsed once: what is read of it is bound to one value.
    """
    parsed = F.from_json(body, _PUSH, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unread"})
    return F.transform(F.array(F.struct(body.alias("body"), parsed.alias("json"))), lambda x: _push_event(x["body"], x["json"]))[0]


def _push_event(body: Column, json: Column) -> Column:
    kind, hook = F.coalesce(json["object_kind"], F.lit("")), F.coalesce(json["hook_name"], F.lit(""))
    # fixed values: the providers' names of their events
    provider = F.when(kind.isin("push", "tag_push"), "gitlab").when(hook.isin("push_hooks", "tag_push_hooks"), "gitee").otherwise("")
    by_kind = F.when(provider == "gitlab", kind == "tag_push").otherwise(hook == "tag_push_hooks")
    places = [("repository", "git_http_url"), ("project", "git_http_url"), ("repository", "url"), ("repository", "git_ssh_url"), ("project", "git_ssh_url"), ("repository", "html_url"), ("project", "html_url")]
    url = F.coalesce(*(F.when(F.trim(json[a][b]) != "", json[a][b]) for a, b in places))
    ref, after = F.coalesce(json["ref"], F.lit("")), F.coalesce(json["after"], F.lit(""))
    known = provider != ""
    tag = known & (by_kind | is_tag(ref))
    branch = F.when(known & ~tag & (ref != ""), F.regexp_replace(ref, "^refs/heads/", ""))
    deleted = known & ~tag & (after == "0" * 40)
    error = (
        F.when(F.coalesce(body, F.lit("")) == "", "body").when(json["unread"].isNotNull(), "json").when(~known, "event").when(url.isNull(), "url")
        .when(~tag & ~deleted & (F.coalesce(branch, F.lit("")) == ""), "branch").otherwise("")
    )
    return F.struct(provider.alias("provider"), F.when(known, url).alias("repo_url"), branch.alias("branch"), tag.alias("tag"), deleted.alias("deleted"), json["before"].alias("before"), after.alias("after"), error.alias("error"))
