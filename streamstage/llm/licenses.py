"""Licence scan: tags and notice phrases by Aho-Corasick, licence expressions by a shunting yard."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import chunks, schema_of, texts

# The base phrases (words joined by spaces) and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases that the method adds.
NOTICES = {
    "mit license": "mit", "apache license": "apache", "apache software license": "apache", "bsd license": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "public domain": "public-domain", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl", "isc license": "isc", "boost software license": "bsl",
    "unlicense": "unlicense", "do not redistribute": "reserved", "proprietary and confidential": "reserved",
}
TAG = "spdx license identifier"
# Licence identifiers (lower case, up to the version) of expressions, and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "bsd": "bsd", "isc": "isc", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "cc0": "cc0",
    "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc-nd": "cc-by-nc-nd",
    "unlicense": "unlicense", "bsl": "bsl", "zlib": "zlib", "0bsd": "bsd",
}
# How freely a text under a licence may be used, from 0 to 1.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "apache": 0.9, "zlib": 0.9, "bsl": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6,
    "cc-by-sa": 0.6, "lgpl": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "reserved": 0.0,
}
UNKNOWN = 0.5

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG = re.compile(r"spdx-license-identifier\x20*:\x20*([^\n]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9.+-]+(?::[a-z0-9.+-]+)?|\S")
_RANK = {"or": 1, "and": 2, "with": 3}


def words(text: str) -> list[bytes]:
    """Words of ASCII letters, digits and all other characters beyond ASCII; A-Z lower-cased."""
    return text.encode("utf-8").translate(_WORD_BYTES).split()


def label_of(identifier: str) -> str:
    """The label of an identifier such as apache-2.0 or gpl-3.0-or-later; the identifier itself if unknown."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier)
    while name and name not in IDENTIFIERS and "-" in name:
        name = name.rpartition("-")[0]
    return IDENTIFIERS.get(name, identifier)


def parse(expression: str) -> list[str]:
    """A licence expression in postfix order, by a shunting yard. WITH binds more than AND, AND more than OR. What
    follows a complete expression in the same line is left out; a broken one gives ValueError."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # an operand is due
    for token in _TOKEN.findall(expression.lower()):
        if operand and token == "(":
            stack.append(token)
        elif operand:
            if token in _RANK or not re.match(r"[a-z0-9]", token):
                raise ValueError(f"no licence at {token!r}")
            out.append(token.rstrip("."))
            operand = False
        elif token in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    if operand or "(" in stack:
        raise ValueError("the expression ends too early")
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """(labels, freedom): OR leaves the freer side's freedom, AND the stricter one's, WITH that of the licence."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _RANK:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, x) if token == "with" else (a | b, max(x, y) if token == "or" else min(x, y)))
        else:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[0]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES, TAG}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text.

        score: the least freedom among the notices and expressions found; UNKNOWN if there are none.
        """
        found = words(text)
        line = f" {b' '.join(found).decode('utf-8')} "
        base, labels, tagged, freedom = [], set(), False, []
        at = seen = 0
        hits = [(end - len(phrase) - 1, phrase) for end, phrase in self.automaton.iter(line)]
        for start, phrase in sorted(hits):
            seen += line.count(" ", at, start)
            at = start
            if phrase in BASE:
                base.append((seen, BASE[phrase]))
            if phrase == TAG:
                tagged = True
            else:
                labels.add(label := BASE.get(phrase) or NOTICES[phrase])
                freedom.append(FREEDOM[label])
        if tagged:
            for m in _TAG.finditer(text.lower()):
                try:
                    more, free = evaluate(parse(m[1]))
                except ValueError:
                    continue
                labels |= more
                freedom.append(free)
        starts = [s for s, _ in base]
        return len(found), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), min(freedom, default=UNKNOWN)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id and what Scanner.scan finds. Null texts count as empty; rows that repeat give a row each;
    columns other than the two are ignored, whatever their names. Nothing is shuffled."""
    ddl = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def scan(batches):
        scanner = Scanner()
        for batch in chunks(batches, "__text"):
            rows = [scanner.scan(x) for x in texts(batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema_of(ddl).types[1:], strict=True)]], schema=schema_of(ddl))

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(scan, ddl).withColumnRenamed("id", id_col)
