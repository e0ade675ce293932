"""URL filters: pattern rules that are found by their rarest literal token.

A url's tokens (runs of a-z and 0-9 of its host, A-Z lowered, and of its path) fetch the rules filed under them; only those run their regular
expression. A rule's tokens are those that every url it fits must have whole; a pattern's are read off its parsed form. Rules without any such token
are tried on every url. Rarity is counted over all urls. Rules are a parameter of the filter, a list that the caller holds in memory.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile("[a-z0-9]+")
_IN_TOKEN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def required_tokens(pattern: str) -> list[str]:
    """Whole tokens that any subject a pattern is found in must have: literal runs with something that ends a token on both sides.

    Only what always matches in a row is looked at: literals, groups without alternatives, anchors, and assertions that no a-z or 0-9 stands
    next. Anything else, and any pattern that ignores case, requires nothing.
    """
    c = re._constants
    tree = re._parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return []
    edge, unknown, out = object(), object(), []

    def flat(items):
        for op, value in items:
            if op is c.LITERAL:
                yield chr(value) if chr(value) in _IN_TOKEN else edge
            elif op is c.SUBPATTERN and not value[1] and not value[2]:
                yield from flat(value[3])
            elif op is c.AT and value in (c.AT_BEGINNING, c.AT_BEGINNING_STRING, c.AT_END_STRING):
                yield edge
            elif op is c.ASSERT_NOT and len(value[1]) == 1 and value[1][0][0] is c.IN:
                none = {chr(x) for kind, v in value[1][0][1] for x in (range(v[0], v[1] + 1) if kind is c.RANGE else [v] if kind is c.LITERAL else ())}
                if value[1][0][1][0][0] is not c.NEGATE and _IN_TOKEN <= none:
                    yield edge
            elif op in (c.ASSERT, c.ASSERT_NOT):
                pass  # takes no room, and what it asks for only narrows
            else:
                yield unknown

    run, whole = "", False
    for x in [unknown, *flat(tree), unknown]:
        if isinstance(x, str):
            run += x
        else:
            if run and whole and x is edge:
                out.append(run)
            run, whole = "", x is edge
    return out


@dataclass(frozen=True)
class Rule:
    """`host/path`: fits the host with all its subdomains, if the url's path starts with the rule's (from its /); or, with pattern, any url part that it is found in."""

    name: str
    verdict: str
    pattern: str | None = None

    def compiled(self) -> re.Pattern:
        if self.pattern is not None:
            return re.compile(self.pattern)
        host, path = self.name.split("/", 1)
        return re.compile(rf"(?:.*\.)?{re.escape(host)}\x00/{re.escape(path)}", re.DOTALL)

    def tokens(self) -> list[str]:
        """Whole tokens that any url the rule fits must have."""
        if self.pattern is not None:
            return required_tokens(self.pattern)
        host, path = self.name.split("/", 1)
        found = _TOKEN.findall(host.lower())
        return found + [t for t in _TOKEN.findall(re.sub(r"[^/]*$", "", path)) if path == path.lower()]


# The filter's rules, and words of hosts that are blocked when no rule fits.
RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]
WORDS = [Rule(w, "block", rf"^[^\x00]*(?<![a-z0-9]){w}(?![a-z0-9])") for w in ("casino", "spam", "adult", "porn", "warez", "viagra", "phishing")]


def parts(url: str | None) -> tuple[str, str]:
    """Host with A-Z lowered, and path; both empty without ://."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def tokens_of(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(host)) | set(_TOKEN.findall(path))


def _count(known: frozenset):
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for url in batch.column("url").to_pylist():
                counts.update(tokens_of(*parts(url)) & known)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], ["token", "n"])

    return run


def _judge(index: dict[str | None, list], default: str):
    def run(batches):
        ready = {t: [(r, r.compiled()) for r in rules] for t, rules in index.items()}
        always = ready.pop(None, [])
        for batch in batches:
            hosts, paths, names, verdicts, tried = [], [], [], [], []
            for url in batch.column("url").to_pylist():
                host, path = parts(url)
                subject = f"{host}\0{path}"
                candidates = always + [x for t in tokens_of(host, path) if t in ready for x in ready[t]]
                fits = [r for r, pattern in candidates if (pattern.match if r.pattern is None else pattern.search)(subject) is not None]
                own = [r for r in fits if r.pattern is None]
                best = max(own, key=lambda r: (len(r.name), r.name), default=None)
                other = min((r for r in fits if r.pattern is not None), key=lambda r: r.name, default=None)
                hosts.append(host)
                paths.append(path)
                names.append(best.name if best else None)
                verdicts.append(best.verdict if best else other.verdict if other else default)
                tried.append(len(candidates))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string()), pa.array(tried, pa.int64())],
                ["page_id", "host", "path", "rule", "verdict", "rules_tried"]
            )

    return run


def url_filter(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """pages(page_id, url, ...) -> (page_id, host, path, rule, verdict, rules_tried), one row for each row.

    The longest host rule that fits decides; else, of the pattern rules that fit, the first by name; else `default`. Null urls and those without :// have an
    empty host and path and fit no host rule. Urls of any length are judged whole; repeated rows come back as often as they stand there; an empty
    table gives an empty result. Of a rule's equally rare tokens the first in order files it, which changes no verdict. Only the columns page_id and url are read.
    """
    rules = RULES + WORDS if rules is None else rules
    known = frozenset(t for r in rules for t in r.tokens())
    urls = pages.select("page_id", "url")
    counted = urls.select("url").mapInArrow(_count(known), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = {r["token"]: r["n"] for r in counted.collect()}  # of the rules' own tokens only
    index: dict[str | None, list] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default=None), []).append(rule)
    return urls.mapInArrow(_judge(index, default), "page_id long, host string, path string, rule string, verdict string, rules_tried long")
