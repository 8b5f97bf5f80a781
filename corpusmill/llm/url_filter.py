"""URL filter: host and path rules first, then a weighted vocabulary matched by Aho-Corasick.

A strict term weighs as much as the limit, so one is enough; soft terms add up, each counted once however
often it occurs. A term counts only where its boundary check holds: both ends, its start or neither end must
lie at a letter or digit's edge. Every page is judged in the task that reads its url, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import own_name

#: Sum of the weights of distinct terms from which a url is rejected.
LIMIT = 1.0

# Which ends of a term must lie at the edge of a word.
BOTH, START, ANY = "both", "start", "any"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
_RESULT = "host string, path string, rule string, verdict string, n_strict int, n_soft int, weight double"


@dataclass(frozen=True)
class Term:
    """A lower-case term, its weight and the ends that must lie at the edge of a word."""

    text: str
    weight: float
    bound: str = BOTH

    @property
    def strict(self) -> bool:
        return self.weight >= LIMIT


# Words of addresses of adult, gambling, drug, fraud and advertising sites.
STRICT = ("porn", "xxx", "hentai", "casino", "viagra", "cialis", "escort", "spam", "malware", "phishing", "warez", "camgirl")
STRICT_WORDS = ("adult", "sex", "sexy", "nude", "nudes", "milf", "xvideos", "torrent", "torrents", "jackpot", "roulette")
SOFT_WORDS = (
    "ad", "ads", "adserver", "banner", "track", "tracker", "tracking", "click", "clicks", "popup", "affiliate", "promo",
    "cheap", "discount", "deal", "deals", "free", "win", "winner", "bonus", "bet", "bets", "betting", "poker", "slots", "lotto",
    "pill", "pills", "pharmacy", "drug", "drugs", "weed", "steroids", "loan", "loans", "payday", "crypto", "forex", "farm",
    "replica", "crack", "keygen", "hot", "girls", "teen", "dating", "live", "cam", "cams", "chat", "kill", "gore",
)


def vocabulary(strict: Iterable[str] = STRICT, strict_words: Iterable[str] = STRICT_WORDS, soft_words: Iterable[str] = SOFT_WORDS) -> tuple[Term, ...]:
    """Terms of a weighted vocabulary: strict from a word's start on, strict whole words, soft whole words of half the limit."""
    return (
        *(Term(text, LIMIT, START) for text in strict), *(Term(text, LIMIT) for text in strict_words),
        *(Term(text, LIMIT / 2) for text in soft_words))


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def shown(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without ``://``. Only A-Z of the host is lower-cased; ports and users stay in it."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((at for at in map(rest.find, "/?#") if at >= 0), default=len(rest))
    path = rest[end:]
    stop = min((at for at in map(path.find, "?#") if at >= 0), default=len(path))
    return rest[:end].translate(_TO_LOWER), path[:stop]


def matched_text(url: str | None) -> str:
    """What the vocabulary sees: the url after its scheme up to ``?`` or ``#``, escapes undone, A-Z lower-cased."""
    _, mark, rest = (url or "").partition("://")
    rest = rest if mark else url or ""
    stop = min((at for at in map(rest.find, "?#") if at >= 0), default=len(rest))
    return unquote(rest[:stop]).translate(_TO_LOWER)


@dataclass(frozen=True)
class UrlFilter:
    """A vocabulary and rules. Of equally long fitting rules the one with the longer host counts, then a blocking one."""

    terms: tuple[Term, ...] = vocabulary()
    rules: tuple[Rule, ...] = ()

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "rules": self.rules}  # each task builds its own automaton

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        built = ahocorasick.Automaton()
        for number, term in enumerate(self.terms):
            if term.text:
                known = built.get(term.text, ())
                built.add_word(term.text, (*known, number))
        if len(built):
            built.make_automaton()
        return built

    @cached_property
    def by_host(self) -> dict[str, dict[str, Rule]]:
        hosts: dict[str, dict[str, Rule]] = {}
        for rule in sorted(self.rules, key=lambda rule: rule.verdict == "block"):
            hosts.setdefault(rule.host.translate(_TO_LOWER), {})[rule.path] = rule
        return hosts

    @cached_property
    def path_lengths(self) -> dict[str, list[int]]:
        return {host: sorted({len(path) for path in paths}, reverse=True) for host, paths in self.by_host.items()}

    def rule_for(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of equally long ones the one with the longer host."""
        best, at = None, 0
        while host:
            suffix = host[at:]
            for length in self.path_lengths.get(suffix, ()):
                if length <= len(path) and (rule := self.by_host[suffix].get(path[:length])):
                    if best is None or len(rule.shown) > len(best.shown):
                        best = rule
                    break
            at = host.find(".", at) + 1
            if not at:
                break
        return best

    def hits(self, text: str) -> set[int]:
        """Numbers of the terms that occur in a text within their boundaries."""
        found: set[int] = set()
        if not len(self.automaton):
            return found
        for last, numbers in self.automaton.iter(text):
            for number in numbers:
                if number in found:
                    continue
                term = self.terms[number]
                first = last - len(term.text) + 1
                open_start = first and text[first - 1].isalnum()
                open_end = last + 1 < len(text) and text[last + 1].isalnum()
                if not (open_start and term.bound in (BOTH, START) or open_end and term.bound == BOTH):
                    found.add(number)
        return found

    def judge(self, url: str | None) -> tuple:
        host, path = split_url(url)
        rule = self.rule_for(host, path)
        terms = [self.terms[number] for number in self.hits(matched_text(url))]
        strict = len({term.text for term in terms if term.strict})
        soft = {term.text: term.weight for term in terms if not term.strict}
        weight = strict * LIMIT + sum(soft.values())
        verdict = rule.verdict if rule else "block" if strict or weight >= LIMIT and len(soft) > 1 else "allow"
        return host, path, rule and rule.shown, verdict, strict, len(soft), weight


_READY: dict[UrlFilter, UrlFilter] = {}


def _ready(filter_: UrlFilter) -> UrlFilter:
    """The filter with the automaton that this worker has built."""
    if filter_ not in _READY:
        _READY.clear()
        _READY[filter_] = filter_
    return _READY[filter_]


def judge(pages: DataFrame, filter_: UrlFilter, url: str = "url") -> DataFrame:
    """``pages`` with the columns host, path, rule, verdict, n_strict, n_soft, weight.

    ``verdict`` is that of the longest rule that fits, else ``block`` for one strict or several distinct soft terms
    of weight LIMIT together, else ``allow``. A null or empty url and one without ``://`` have an empty host and
    path, fit no rule, and are judged by the terms of the whole string. Repeated rows are judged alike, columns of
    ``pages`` with the names above are replaced, an empty table gives no rows.
    """
    names = [part.split()[0] for part in _RESULT.split(", ")]

    def judged(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_ready(filter_).judge(value) for value in urls], columns=names)

    rest = [f"`{name}`" for name in pages.columns if name.lower() not in names]
    own = own_name(pages, "judged")
    return pages.withColumn(own, F.pandas_udf(judged, _RESULT)(F.col(url))).select(*rest, f"`{own}`.*")


def keep_allowed(pages: DataFrame, filter_: UrlFilter, url: str = "url") -> DataFrame:
    """The rows of ``pages`` that are allowed, in their own columns."""
    own = own_name(pages, "verdict")
    verdict = F.pandas_udf(lambda urls: pd.Series([_ready(filter_).judge(value)[3] for value in urls], dtype=object), "string")
    return pages.withColumn(own, verdict(F.col(url))).where(F.col(own) == "allow").drop(own)
