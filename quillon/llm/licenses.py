"""License scan by template markup.

A template is license wording with marked regions, after the public SPDX matching guidelines:
``<<beginOptional>> ... <<endOptional>>`` may be left out and ``<<var;N>>`` stands for 0 to N words of any kind.
``compile_template`` turns it into a token automaton; a text is accepted where every mandatory word follows exactly.
TEMPLATES are whole notices and licenses with their disclaimers, REFERENCES the short ways to name a license.

Texts are lower-cased (A-Z only) and cut to words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, templates likewise. Null and empty
texts have no words: n_words and n_base are 0, first_word and last_word null, labels ''. The score is FULL for a text that a
template accepts, REFERENCE for one with a reference, PHRASE for one with base phrases, else half the largest share of a
template's mandatory words that follow from its beginning. Repeated rows each get their row; columns other than the id
and the text are not read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import WORD_BYTES, as_batch, pieces, raw

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of public licenses and notices.
CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<var;1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<var;1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
NO_NAMES = (
    "<<var;1>> Neither the name of <<var;15>> nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY <<var;12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def gpl_notice(name: str, version: str) -> str:
    return (
        f"is free software you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"<<beginOptional>>either<<endOptional>> version {version} of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>. <<var;4>> is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        f"PARTICULAR PURPOSE. See the {name} for more details."
    )


TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall "
        "be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "<<var;12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;6>> DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;6>> BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "bsd-2-clause": [CONDITIONS + DISCLAIMER],
    "bsd-3-clause": [CONDITIONS + NO_NAMES + DISCLAIMER],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>; you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at <<var;12>> Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the License.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at",
    ],
    "gpl-2.0": [gpl_notice("GNU General Public License", "2")],
    "gpl-3.0": [gpl_notice("GNU General Public License", "3")],
    "agpl-3.0": [gpl_notice("GNU Affero General Public License", "3")],
    "lgpl-2.1": [gpl_notice("GNU Lesser General Public License", "2.1")],
    "lgpl-3.0": [gpl_notice("GNU Lesser General Public License", "3")],
    "cc-by-4.0": ["This work is licensed under <<var;1>> <<beginOptional>>Creative Commons<<endOptional>> Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["This work is licensed under <<var;1>> <<beginOptional>>Creative Commons<<endOptional>> Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["This work is licensed under <<var;1>> <<beginOptional>>Creative Commons<<endOptional>> Attribution-NonCommercial 4.0 International License"],
    "copyright-notice": ["Copyright <<beginOptional>>(c)<<endOptional>> <<var;12>> All rights reserved"],
}
# Short ways to name a license.
UNDER, TERMS = "licensed under", "<<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>>"
REFERENCES = {
    "mit": [f"released under {TERMS} MIT License", f"{UNDER} {TERMS} MIT License"],
    "apache-2.0": [f"{UNDER} {TERMS} Apache License <<beginOptional>>version<<endOptional>> 2.0"],
    "gpl-2.0": [f"{UNDER} {TERMS} GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2"],
    "gpl-3.0": [f"{UNDER} {TERMS} GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"],
    "cc-by-4.0": [f"{UNDER} <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY 4.0"],
    "cc-by-nc-4.0": [f"{UNDER} <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY NC 4.0"],
}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
FULL, REFERENCE, PHRASE, PART = 1.0, 0.8, 0.6, 0.5
LEAD_WORDS = 6  # words of a template's beginning that are looked for in a text before the automaton is run there

MARKUP = re.compile(r"<<(beginOptional|endOptional|var;\d+)>>|((?:(?!<<)[\s\S])+)")


class Automaton(NamedTuple):
    """moves: next state by word (None: any word) for each state; free: states reached without a word; done: mandatory words
    before a state; lead: the mandatory words it begins with, LEAD_WORDS at most, joined by spaces."""

    moves: list[dict]
    free: list[list[int]]
    done: list[int]
    lead: bytes

    @property
    def last(self) -> int:
        return len(self.moves) - 1


def compile_template(template: str) -> Automaton:
    """The automaton of a template; fails on an optional region that isn't closed and on a beginning without mandatory words."""
    moves: list[dict] = [{}]
    free: list[list[int]] = [[]]
    done = [0]
    opened: list[int] = []
    lead: list[bytes] = []
    leading = True

    def state(mandatory: int = 0) -> int:
        moves.append({})
        free.append([])
        done.append(done[-1] + mandatory)
        return len(moves) - 1

    def step(word: bytes | None, mandatory: bool = False) -> None:
        before = moves[-1]
        before[word] = state(mandatory)

    for mark, text in MARKUP.findall(template):
        if text:
            for word in text.encode().translate(WORD_BYTES).split():
                step(word, not opened)
                lead += [word] if leading else []
        elif mark == "beginOptional":
            opened.append(len(moves) - 1)
            free[opened[-1]].append(state())
        elif mark == "endOptional":
            free[opened.pop()].append(len(moves) - 1)
        else:
            before = len(moves) - 1
            for _ in range(int(mark.partition(";")[2])):
                step(None)
            for skipped in range(before, len(moves) - 1):
                free[skipped].append(len(moves) - 1)
        leading = leading and bool(text)
    if opened:
        raise ValueError("an optional region is not closed")
    if not lead:
        raise ValueError("a template must begin with mandatory words")
    return Automaton(moves, free, done, b" ".join(lead[:LEAD_WORDS]))


def reach(states: set[int], free: list[list[int]]) -> set[int]:
    todo = list(states)
    while todo:
        for nxt in free[todo.pop()]:
            if nxt not in states:
                states.add(nxt)
                todo.append(nxt)
    return states


def share(automaton: Automaton, words: list[bytes], start: int) -> float:
    """The share of the template's mandatory words that follow from words[start] on; 1.0 if it is accepted."""
    moves, free, done, _ = automaton
    states, most = reach({0}, free), 0
    for at in range(start, len(words)):
        word = words[at]
        states = reach({moves[s][w] for s in states for w in (word, None) if w in moves[s]}, free)
        if not states:
            break
        if automaton.last in states:
            return 1.0
        most = max(most, *(done[s] for s in states))
    return min(most / done[-1], 1 - 1 / (done[-1] + 1))


def accepts(automaton: Automaton, words: list[bytes], start: int) -> bool:
    """Whether the template matches from words[start] on."""
    return share(automaton, words, start) == 1.0


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions of a phrase in words that are joined by, begun and ended with single spaces."""
    out, at, words, seen = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        out.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


def scanner(phrases: dict[str, str], templates: dict[str, list[str]], references: dict[str, list[str]]):
    compiled = lambda named: [(label, compile_template(t)) for label, many in named.items() for t in many]
    whole, brief = compiled(templates), compiled(references)
    base = [(p.encode(), label) for p, label in phrases.items()]

    def scan(text: bytes | None) -> tuple:
        words = (text or b"").translate(WORD_BYTES).split()
        joined = b" " + b" ".join(words) + b" "
        hits = {label: found for phrase, label in base if (found := places(joined, phrase))}
        shares = [(max((share(a, words, at) for at in places(joined, a.lead)), default=0.0), label) for label, a in whole]
        full = {label for part, label in shares if part == 1.0}
        named = {label for label, a in brief if any(accepts(a, words, at) for at in places(joined, a.lead))}
        at = sorted(x for found in hits.values() for x in found)
        part = PART * max((x for x, _ in shares), default=0.0)
        score = FULL if full else max(REFERENCE if named else 0.0, PHRASE if hits else 0.0, part)
        return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(hits)), ",".join(sorted(full | named | set(hits))), score

    return scan


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, references: dict[str, list[str]] = REFERENCES) -> DataFrame:
    """One row per row of docs (doc_id, text)."""
    scanner(phrases, templates, references)  # a wrong template fails here, not in a task

    def run(batches):
        scan = scanner(phrases, templates, references)
        schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
        for batch in pieces(batches, "text"):
            rows = [scan(t) for t in raw(batch, "text")]
            yield as_batch(schema, batch.column("doc_id"), *map(list, zip(*rows, strict=True)))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
