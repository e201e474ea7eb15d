"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton holds every run of words of every template. A document is streamed through it:
at each word it knows the longest run ending there that some template has (the matching
statistics). Long matches are chained, template by template, into spans of the document with
the share of the template that they cover; of spans that overlap, as those of related licences
do, the best stays. Words outside all templates end a match, so only stretches of template words
are streamed. A projection: no shuffle at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_words

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Parts of the Creative Commons licences and their versions: their notices follow from a rule.
COMMONS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
COMMONS_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
COMMONS_VERSIONS = ("4.0 International", "3.0 Unported", "2.0 Generic")
#: Identifiers of licence lines in source files, and the label of each.
IDENTIFIERS = {
    "MIT": "mit", "Apache-2.0": "apache", "GPL-2.0": "gpl", "GPL-3.0": "gpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "MPL-2.0": "mpl", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause",
    "ISC": "isc", "EPL-2.0": "epl", "BSL-1.0": "boost", "Zlib": "zlib", "Unlicense": "unlicense", "CC0-1.0": "cc0",
}
#: Words of a match that counts, words between matches that a chain bridges, and covered share and words that make a label.
SHORTEST, BRIDGE, SHARE, LEAST = 3, 12, 0.6, 5


def templates_of(path: Path = Path(__file__).with_name("data") / "license_templates.tsv") -> list[tuple[str, str]]:
    """``(label, text)`` of names, short notices and the openings of public licences: lines of a file, and licence lines and those of Creative Commons by rule."""
    out = [tuple(line.split("\t", 1)) for line in path.read_text(encoding="utf-8").splitlines() if line]
    out += [(label, f"SPDX-License-Identifier: {name}") for name, label in IDENTIFIERS.items()]
    for kind in COMMONS_KINDS:
        out += [(f"cc-{kind}", f"SPDX-License-Identifier: CC-{kind.upper()}-{version.split()[0]}") for version in COMMONS_VERSIONS]
        name = "-".join(COMMONS[k] for k in kind.split("-"))
        for version in COMMONS_VERSIONS:
            out.append((f"cc-{kind}", f"This work is licensed under a Creative Commons {name} {version} License."))
            out.append((f"cc-{kind}", f"Creative Commons {name} {version}"))
            out.append((f"cc-{kind}", f"This work is licensed under CC {kind.upper()} {version.split()[0]}."))
    return out


TEMPLATES = templates_of()


class SuffixAutomaton:
    """All runs of words of the templates; each state knows the places where its runs end."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        for t, words in enumerate(templates):
            last = 0
            for end, word in enumerate(words):
                last = self._grow(last, word)
                self.ends[last].append((t, end))
        # runs of a state also end wherever those of the states that link to it do
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        twin = self._state(self.length[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def _grow(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:  # the run is known from an earlier template
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def matches(self, words: list[int], base: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """``(end, length, places)`` of the matches of at least SHORTEST words that the next word does not prolong."""
        state = length = 0
        for i, word in enumerate([*words, 0]):
            before, was = state, length
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
            if was >= SHORTEST and length <= was:
                yield base + i - 1, was, self.ends[before]


def _best_chains(matches: list[tuple[int, int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """``(first, last, covered)`` of chains of one template's matches ``(first, last, t_first, t_last)``, ordered by last: one for each place of the text."""
    best: list[tuple[int, int, int, int]] = []  # of the best chain that ends in each match: gain, first word, covered, match before
    low = 0
    for k, (first, last, t_first, t_last) in enumerate(matches):
        own = last - first + 1
        gain, start, covered, before = own, first, own, -1
        while matches[low][1] < first - BRIDGE - 1 - size:
            low += 1
        for j in range(k - 1, low - 1, -1):
            _, p_last, _, p_t_last = matches[j]
            if p_t_last >= t_last or p_last >= last or first - p_last - 1 > BRIDGE:
                continue
            # words that both hold count once; words of either text between them are bridged
            new = min(own, last - p_last, t_last - p_t_last)
            bridged = max(0, first - p_last - 1)
            if best[j][0] + new - bridged > gain:
                gain, start, covered, before = best[j][0] + new - bridged, best[j][1], best[j][2] + new, j
        best.append((gain, start, covered, before))
    # chains from the best on; a match belongs to one
    out, used = [], set()
    for k in sorted(range(len(best)), key=lambda k: (-best[k][0], k)):
        if k in used:
            continue
        at = k
        while at >= 0 and at not in used:
            used.add(at)
            at = best[at][3]
        if at < 0:
            out.append((best[k][1], matches[k][1], best[k][2]))
    return out


def _best_of_relatives(spans: list[dict]) -> list[dict]:
    """Of spans that share more than half of the shorter one, the one that covers most words (then the greater share, the lesser label)."""
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: (-s["covered"], -s["share"], s["label"], s["first_word"], s["last_word"])):
        shared = lambda o: min(s["last_word"], o["last_word"]) - max(s["first_word"], o["first_word"]) + 1
        shorter = lambda o: min(s["last_word"] - s["first_word"], o["last_word"] - o["first_word"]) + 1
        if all(2 * shared(o) <= shorter(o) for o in kept):
            kept.append(s)
    return kept


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], base: dict[str, str]):
        self.labels = [label for label, _ in templates]
        texts = [ascii_words(t) for _, t in templates]
        phrases = [ascii_words(p) for p in base]
        self.ids = {w: n for n, w in enumerate(dict.fromkeys(w for t in texts + phrases for w in t), 1)}
        self.sizes = [len(t) for t in texts]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in t] for t in texts])
        self.phrases = [([self.ids[w] for w in p], label) for p, label in zip(phrases, base.values(), strict=True)]

    def chains(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(template, first word, last word, template words covered)`` of the best chains of matches of each template.

        A chain takes matches in the order of both texts, with at most BRIDGE words between; of all chains
        that end in a match the one that covers most words, less those bridged, is kept.
        """
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < SHORTEST:
                continue
            for end, n, places in self.automaton.matches(ids[a:b].tolist(), a):
                for t, t_end in places:
                    found.setdefault(t, []).append((end - n + 1, end, t_end - n + 1, t_end))
        out = []
        for t, matches in found.items():
            if sum(m[1] - m[0] + 1 for m in matches) >= min(LEAST, SHARE * self.sizes[t]):
                out += [(t, *chain) for chain in _best_chains(matches, self.sizes[t])]
        return out

    def scan(self, text: str | None) -> dict:
        words = ascii_words(text)
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))
        starts, base = [], set()
        for phrase, label in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n > 0:
                at = np.flatnonzero(np.logical_and.reduce([ids[k : k + n] == w for k, w in enumerate(phrase)]))
                if len(at):
                    base.add(label)
                    starts.append(at)
        places = np.concatenate(starts) if starts else np.array([], np.int64)
        spans = []
        for t, first, last, covered in self.chains(ids) if len(ids) else ():
            # share of the template that is covered, less for foreign words within the span
            share = covered / self.sizes[t] * covered / max(covered, last - first + 1)
            # a template of few words counts only whole
            if covered >= min(LEAST, self.sizes[t]) and share >= (SHARE if self.sizes[t] >= LEAST else 1):
                spans.append({"label": self.labels[t], "first_word": first, "last_word": last, "share": share, "covered": covered})
        spans = _best_of_relatives(spans)
        spans.sort(key=lambda s: (s["first_word"], s["last_word"], s["label"], s["share"]))
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": int(places.min()) if len(places) else None,
            "last_word": int(places.max()) if len(places) else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s["label"] for s in spans})),
            "score": max([0.5 * bool(base), *(s["share"] for s in spans)]),
            "spans": [{k: v for k, v in s.items() if k != "covered"} for s in spans],
        }


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPANS)]
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,share:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per document: words, places of the base phrases, labels, score and the covered spans.

    A label comes from a base phrase or from a chain that covers SHARE of a template and LEAST of
    its words (all of them where it has fewer), and more of them than chains of other templates at the same place. ``score`` is the
    largest share covered, and 0.5 at least with a base phrase. Null and empty texts have no words,
    empty labels and score 0. Whole texts are scanned, whatever their length. Repeated rows are judged
    each; null ids stay null; an empty table gives no rows; columns beyond the two are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            found = list(map(scanner.scan, batch.column(1).to_pylist()))
            columns = [pa.array([f[name] for f in found], kind) for name, kind in _FIELDS]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", *(n for n, _ in _FIELDS)])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(scan, _SCHEMA)
