"""License scans by matching texts against templates with markup.

A template is plain wording with two kinds of regions, marked as in the public
SPDX matching guidelines: ``<<beginOptional>>...<<endOptional>>`` may be absent and
``<<var;name=...;match=N>>`` stands for up to N words of any kind.  Each
template is compiled to an automaton over words and accepts a place in a text
only if all its mandatory words stand there exactly and in order.  All templates
run in one pass over a text's words, started only where a template can begin.

Whole licenses and license headers are templates, with titles and copyright lines optional and
names replaceable; a text that leaves out or changes a mandatory word is not accepted.  Short notices
that name a license are templates too.  Beside the templates there are base phrases: their places are counted wherever
their words stand consecutively.

Defined results: a null or empty text has no words, no places and score 0; a very long text is
walked whole; ties do not arise, as labels are sorted and distinct; repeated rows are answered each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textcore import ALNUM_WORDS, Words, slices

#: Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The wording of public licenses, with what may be left out and what is replaced by names.
_COPYRIGHT = "<<beginOptional>>copyright <<var;name=copyright;match=24>><<endOptional>>"
_BSD_START = """redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """this software is provided by <<var;name=holder;match=10>> "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.
in no event shall <<var;name=holder;match=10>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""
_GPL = """this <<var;name=what;match=3>> is free software <<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation <<beginOptional>>,<<endOptional>> {version}
this <<var;name=what;match=3>> is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details.
<<beginOptional>>you should have received a copy of the gnu general public license along with this <<var;name=what;match=3>> if not, see <<var;name=where;match=8>><<endOptional>>"""

#: Whole licenses, or the headers that stand for them, by label.
LICENSES = {
    "mit-license": f"""<<beginOptional>>the <<endOptional>><<beginOptional>>mit license<<endOptional>> <<beginOptional>>mit<<endOptional>> {_COPYRIGHT}
permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=what;match=6>> (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:
the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software.
the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.
in no event shall <<var;name=holder;match=10>> be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.""",
    "isc": f"""<<beginOptional>>isc license<<endOptional>> {_COPYRIGHT}
permission to use, copy, modify, and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
the software is provided "as is" and <<var;name=holder;match=8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.
in no event shall <<var;name=holder;match=8>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.""",
    "bsd-2-clause": f"{_COPYRIGHT} {_BSD_START} {_BSD_END}",
    "bsd-3-clause": f"""{_COPYRIGHT} {_BSD_START}
<<beginOptional>>3.<<endOptional>> neither the name of <<var;name=holder;match=10>> nor the names of <<var;name=its;match=3>> contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}""",
    "zlib": f"""{_COPYRIGHT} this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software.
permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<beginOptional>>1.<<endOptional>> the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
<<beginOptional>>2.<<endOptional>> altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<beginOptional>>3.<<endOptional>> this notice may not be removed or altered from any source distribution.""",
    "apache-2.0-header": f"""{_COPYRIGHT} licensed under the apache license, version 2.0 (the "license"); you may not use this <<var;name=what;match=2>> except in compliance with the license. you may obtain a copy of the license at <<var;name=where;match=10>>
unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.""",
    "gpl-2.0-header": _GPL.format(version="<<beginOptional>>either<<endOptional>> version 2 of the license <<beginOptional>>, or (at your option) any later version.<<endOptional>>"),
    "gpl-3.0-header": _GPL.format(version="<<beginOptional>>either<<endOptional>> version 3 of the license <<beginOptional>>, or (at your option) any later version.<<endOptional>>"),
}

#: Notices that name a license, by label.
NOTICES = {
    "mit-notice": "<<beginOptional>>this <<var;name=what;match=2>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "apache-2.0": "<<beginOptional>>this <<var;name=what;match=2>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2 0",
    "gpl-notice": "<<beginOptional>>this <<var;name=what;match=2>> is<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> gnu general public license",
    "gpl-3.0": "gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "gpl-2.0": "gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2",
    "cc-by-4.0": "<<beginOptional>>licensed<<endOptional>> under <<beginOptional>>a<<endOptional>> cc by 4 0",
    "cc-by-nc-4.0": "<<beginOptional>>licensed<<endOptional>> under <<beginOptional>>a<<endOptional>> cc by nc 4 0",
    "cc-by-sa-4.0": "<<beginOptional>>licensed<<endOptional>> under <<beginOptional>>a<<endOptional>> cc by sa 4 0",
}

#: Wording that keeps rights and gives none.
CLAIMS = {"all-rights-reserved": "<<beginOptional>>copyright <<var;name=owner;match=8>><<endOptional>> all rights reserved"}

TEMPLATES = LICENSES | NOTICES | CLAIMS

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^<>]*)>>")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ANY = None


@dataclass
class Automaton:
    """States 0..accept; ``steps[s]`` has (word or ANY, next state), ``free[s]`` states reached for nothing."""

    steps: list[list[tuple[str | None, int]]]
    free: list[set[int]]
    accept: int
    mandatory: int

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def starts(self) -> set[str | None]:
        return {w for s in self.closure({0}) for w, _ in self.steps[s]}

    def match(self, words: list[str], at: int) -> int:
        """The end of the longest accepted run that begins at ``at``; -1 if there is none."""
        states, end = self.closure({0}), -1
        while True:
            if self.accept in states:
                end = at
            if at >= len(words) or not states:
                return end
            word = words[at]
            states = self.closure({t for s in states for w, t in self.steps[s] if w is ANY or w == word})
            at += 1


def compile_template(template: str) -> Automaton:
    """An automaton of a template; markup must be balanced and some words must be mandatory."""
    steps: list[list[tuple[str | None, int]]] = [[]]
    free: list[set[int]] = [set()]
    opened: list[int] = []
    mandatory = 0

    def new() -> int:
        steps.append([])
        free.append(set())
        return len(steps) - 1

    at = 0
    for k, part in enumerate(_MARK.split(template)):
        if k % 2 == 0:
            for word in _WORD.findall(part.lower()):
                to = new()
                steps[at].append((word, to))
                at = to
                mandatory += not opened
        elif part == "beginOptional":
            opened.append(at)
        elif part == "endOptional":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            free[opened.pop()].add(at)
        else:
            most = int(re.search(r"match=(\d+)", part)[1]) if "match=" in part else 1
            begin = at
            for _ in range(most):
                to = new()
                steps[at].append((ANY, to))
                free[begin].add(to) if at == begin else free[at].add(to)
                at = to
    if opened:
        raise ValueError("beginOptional without endOptional")
    if not mandatory:
        raise ValueError("a template needs mandatory words")
    return Automaton(steps, free, at, mandatory)


def template_pattern(template: str) -> str:
    """The same language as a regular expression over words that each have a space before them, for SQL and tests."""
    out = []
    for k, part in enumerate(_MARK.split(template)):
        if k % 2 == 0:
            out += [f" {w}" for w in _WORD.findall(part.lower())]
        elif part == "beginOptional":
            out.append("(?:")
        elif part == "endOptional":
            out.append(")?")
        else:
            most = int(re.search(r"match=(\d+)", part)[1]) if "match=" in part else 1
            out.append(f"(?: [^ ]+){{0,{most}}}")
    return "".join(out)


class Scanner:
    """All templates and base phrases, ready to run over texts."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE):
        self.base = [(tuple(p.split()), label) for p, label in base.items()]
        self.automata = {label: compile_template(t) for label, t in templates.items()}
        self.by_start: dict[str, list[str]] = {}
        self.anywhere: list[str] = []
        for label, a in self.automata.items():
            starts = a.starts()
            if ANY in starts:
                self.anywhere.append(label)
            else:
                for w in starts:
                    self.by_start.setdefault(w, []).append(label)
        # A text without the rarest-looking mandatory word of anything needs no automaton run.
        self.needed = {max((w for w, _ in self._mandatory(t)), key=len) for t in templates.values()} | {p[0] for p, _ in self.base}
        self.hint = re.compile("|".join(sorted(re.escape(w) for w in self.needed)))

    @staticmethod
    def _mandatory(template: str):
        depth = 0
        for k, part in enumerate(_MARK.split(template)):
            if k % 2 == 0 and not depth:
                yield from ((w, 1) for w in _WORD.findall(part.lower()))
            elif k % 2:
                depth += {"beginOptional": 1, "endOptional": -1}.get(part, 0)

    def scan(self, words: list[str]):
        """(base places as (start, label)), (template matches as (label, start, end))."""
        places, found = [], []
        ends: dict[str, int] = {}
        for i, w in enumerate(words):
            for phrase, label in self.base:
                if w == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase:
                    places.append((i, label))
            for label in (*self.by_start.get(w, ()), *self.anywhere):
                if i >= ends.get(label, 0):
                    end = self.automata[label].match(words, i)
                    if end > i:
                        found.append((label, i, end))
                        ends[label] = end
        return places, found


SPANS = "array<struct<label:string,start:long,end:long>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def _ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """Per document: its words, base places, labels of phrases and templates, spans of templates, and a score.

    score: 1 if a license, or a notice that names one, is accepted, 0.5 for base phrases alone, 0.25 for a claim of rights
    alone, else 0.
    """

    def run(batches):
        scanner = Scanner(templates, base)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for at, part in slices(column):
                counts = Words(part, ALNUM_WORDS, hashed=False).counts
                rows = []
                for k, text in enumerate(part.to_pylist()):
                    low = _ascii_lower(text or "")
                    places, found = scanner.scan(_WORD.findall(low)) if scanner.hint.search(low) else ([], [])
                    base_labels = sorted({x for _, x in places})
                    labels = sorted({*base_labels, *(x for x, _, _ in found)})
                    starts = [i for i, _ in places]
                    rows.append((len(places), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), 1.0 if any(x not in CLAIMS for x, _, _ in found) else 0.5 if places else 0.25 if found else 0.0, [{"label": a, "start": b, "end": c} for a, b, c in found]))
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
                arrays = [ids.slice(at, len(part)), pa.array(np.asarray(counts, np.int64)), *[pa.array(c, t) for c, t in zip(cols, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """License labels of every whole document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _oracle_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    places = " || ".join(
        "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in BASE
    )
    base = ", ".join(f"CASE WHEN regexp_matches(s, ' {p} ') THEN '{label}' END" for p, label in BASE.items())
    found = {x: f"regexp_matches(s, '{template_pattern(t)} ')" for x, t in TEMPLATES.items()}
    own = ", ".join(f"CASE WHEN {m} THEN '{x}' END" for x, m in found.items())
    text = lambda v: f"array_to_string(list_sort(list_distinct(list_filter({v}, lambda x: x IS NOT NULL))), ',')"
    claims = ", ".join(f"'{x}'" for x in CLAIMS)
    return f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{words}') AS w FROM documents
), p AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {places} AS places FROM t
), l AS (
  SELECT doc_id, w, places, [{base}] AS base, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM p
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  {text('base')} AS base_labels, {text('base || own')} AS labels,
  CASE WHEN len(list_filter(own, lambda x: x NOT IN ({claims}))) > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5 WHEN len(own) > 0 THEN 0.25 ELSE 0 END AS score
FROM l"""


#: The same by regular expressions, which the templates are.
ORACLE_SQL = _oracle_sql()
