"""License scans: notices as templates with optional and replaceable regions, compiled into one automaton over words.

Markup: [[ ... ]] may be left out, also one inside another; {{n}} stands for up to n words of any kind, a|b for either word; all
else is mandatory wording that a text must have exactly. A notice in whole is accepted as that, and a shorter reference too. Words are runs of letters, digits and what isn't ASCII, A-Z in lower case. The
automaton of all templates is made deterministic as texts visit its states, and reads each word once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.common import byte_strings, pieces, table
from vecspark.llm.words import LETTERS

#: The phrases that count as base places, and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: The wording of well-known notices in whole, by words. What differs from project to project is optional or replaceable.
NOTICES = (
    ("mit", """[[the]] [[mit|expat|x11]] [[license]] [[copyright [[c]] {{24}} [[all rights reserved]]]]
        permission is hereby granted free of charge to any person obtaining a copy of this software and [[associated]] documentation files {{5}}
        to deal in the {{4}} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{4}}
        and to permit persons to whom the {{4}} is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the {{4}}
        the {{4}} is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall the {{12}} be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the {{4}} or the use or other dealings in the {{4}}"""),
    ("mit-0", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so the software is provided as is without warranty of any kind"""),
    ("isc", """[[isc license]] [[copyright [[c]] {{24}}]]
        permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and {{8}} disclaims|disclaim all warranties with regard to this software including all implied warranties of merchantability and fitness
        in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("bsd-2", """redistribution and use [[of {{8}}]] in source and binary forms with or without modification are permitted provided that the following conditions are met
        [[1|a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [[2|b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        this software is provided by {{16}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
        in no event shall {{16}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
        arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    ("bsd-3", """redistribution and use [[of {{8}}]] in source and binary forms with or without modification are permitted provided that the following conditions are met
        [[1|a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [[2|b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        [[3|c]] neither the name of {{16}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
        this software is provided by {{16}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
        in no event shall {{16}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
        arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    ("apache-2", """[[copyright [[c]] {{24}}]] licensed under the apache license version 2 0 the license you may not use this file|work|software except in compliance with the license
        you may obtain a copy of the license at http|https www apache org licenses license 2 0 [[txt|html]]
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license"""),
    ("gpl-3", """{{6}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
        either version 3 of the license or at your option any later version {{6}} is distributed in the hope that it will be useful but without any warranty
        without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
        you should have received a copy of the gnu general public license along with {{6}} if not see [[http|https]] [[www gnu org licenses]]"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software
        if you use this software in a product an acknowledgment|acknowledgement in the product documentation would be appreciated but is not required
        [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        [[3]] this notice may not be removed or altered from any source distribution"""),
    ("unlicense", """this is free and unencumbered software released into the public domain
        anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    ("wtfpl", """do what the fuck you want to public license [[version 2 [[december 2004]]]] {{24}} everyone is permitted to copy and distribute verbatim or modified copies of this license document
        and changing it is allowed as long as the name is changed do what the fuck you want to public license terms and conditions for copying distribution and modification
        0 you just do what the fuck you want to"""),
)
#: Shorter wording by which a text refers to a license.
REFERENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of {{12}} to deal in {{6}} without restriction"),
    ("mit", "[[licensed|released|distributed|available]] under the [[terms of the]] [[expat|x11]] mit license"),
    ("apache-2", "licensed under the apache license version 2 0 [[the license]]"),
    ("apache-2", "apache license [[version]] 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3", "gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or at your option any later version]]"),
    ("gpl-2", "gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]] [[or at your option any later version]]"),
    ("agpl-3", "gnu affero general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("lgpl", "gnu lesser|library general public license [[as published by the free software foundation]] [[either]] version 2|3"),
    ("mpl-2", "mozilla public license [[version|v]] 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "[[licensed under]] cc by 1|2|3|4 0"),
    ("cc-by-sa", "[[licensed under]] cc by sa [[1|2|3|4 0]]"),
    ("cc-by-nc", "[[licensed under]] cc by nc [[1|2|3|4 0]]"),
    ("cc-by-nc", "creative commons attribution noncommercial [[1|2|3|4 0]] [[international]] [[public]] license"),
    ("cc-by", "creative commons attribution [[1|2|3|4 0]] [[international]] [[public]] license"),
    ("cc0", "creative commons [[cc0]] [[1 0]] universal [[public domain dedication]]"),
)
TEMPLATES = NOTICES + REFERENCES
#: States that a worker keeps before it makes them anew.
MOST_STATES = 20_000


class Automaton:
    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        self.labels = [label for label, _ in templates]
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[bytes] | None, int] | None] = []  # None as the words: any
        self.starts, self.ends = [], {}
        for i, (_, markup) in enumerate(templates):
            start, end = self._compile(markup)
            self.starts.append(self._closed({start}))
            self.ends[end] = i
        self.vocabulary = {w for m in self.moves if m and m[0] for w in m[0]}
        self.begin = frozenset().union(*self.starts)
        self._reset()

    def _state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def _compile(self, markup: str) -> tuple[int, int]:
        start = at = self._state()
        opened = []
        for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
            to = self._state()
            if token == "[[":
                self.empty[at].append(to)
                opened.append(at)
            elif token == "]]":
                self.empty[at].append(to)
                self.empty[opened.pop()].append(to)
            elif token.startswith("{{"):
                for _ in range(int(token[2:-2])):
                    self.empty[at].append(to)
                    self.moves[at] = (None, new := self._state())
                    at = new
                self.empty[at].append(to)
            else:
                self.moves[at] = (frozenset(token.encode().split(b"|")), to)
            at = to
        return start, at

    def _closed(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _reset(self) -> None:
        self.number: dict[frozenset[int], int] = {self.begin: 0}
        self.sets, self.steps, self.accepts = [self.begin], [{}], [()]

    def _next(self, states: frozenset[int], word: bytes | None) -> frozenset[int]:
        return self._closed({m[1] for x in states if (m := self.moves[x]) and (m[0] is None or word in m[0])})

    def _step(self, state: int, word: bytes | None) -> int:
        to = self._next(self.sets[state], word) | self.begin
        if to not in self.number:
            self.number[to] = len(self.sets)
            self.sets.append(to)
            self.steps.append({})
            self.accepts.append(tuple(sorted(self.ends[x] for x in to if x in self.ends)))
        self.steps[state][word] = self.number[to]
        return self.number[to]

    def ends_in(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(end word exclusive, template) of all matches."""
        if len(self.sets) > MOST_STATES:
            self._reset()
        out, state, steps, accepts = [], 0, self.steps, self.accepts
        known = {w: w for w in self.vocabulary}
        for i, word in enumerate(map(known.get, words), 1):
            if word is None and not state:
                continue
            to = steps[state].get(word)
            state = self._step(state, word) if to is None else to
            if accepts[state]:
                out += [(i, t) for t in accepts[state]]
        return out

    def start_of(self, words: list[bytes], end: int, template: int) -> int:
        """The latest start of a match of the template that ends there."""
        states_at = self.starts[template]
        for start in range(end - 1, -1, -1):
            states = states_at
            for i in range(start, end):
                states = self._next(states, words[i])
                if not states:
                    break
            if any(self.ends.get(x) == template for x in states):
                return start
        raise ValueError("no match of the template ends here")


MATCHES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find_licenses(df: DataFrame, text: str = "text", base: tuple[tuple[str, str], ...] = BASE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """df with n_words long and license_matches: an array of (label, start, end, base) in words, end exclusive, by end.

    base tells places of base phrases from those of the templates. A match that goes on through an optional region is given
    at each of its ends. An empty text or a null has no words. Columns of df with these names are replaced.
    """
    new = ("n_words", "license_matches")
    df = df.drop(*new)
    column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton((*base, *templates))
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in pieces(batches, column):
            counts, matches = [], []
            for x in byte_strings(batch.column(column)):
                words = x.translate(LETTERS).split()
                counts.append(len(words))
                matches.append([{"label": automaton.labels[t], "start": automaton.start_of(words, end, t), "end": end, "base": t < len(base)} for end, t in automaton.ends_in(words)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(matches, kind)], [*batch.schema.names, *new])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(new[0], T.LongType()), T.StructField(new[1], MATCHES)]))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """Places and labels in every whole document; score is the share of its words that matches cover."""
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.filter("license_matches", lambda m: m.base)
    starts = F.transform(places, lambda m: m.start)
    joined = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.label))), ",")
    by_start = F.array_sort(F.transform("license_matches", lambda m: F.struct(m.start.alias("start"), m.end.alias("end"))))
    none = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(by_start, none, lambda a, m: F.struct((a.covered + F.greatest(F.lit(0), m.end - F.greatest(m.start, a.to))).alias("covered"), F.greatest(a.to, m.end).alias("to"))).covered
    score = F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(0.0)
    return found.select("doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(places).alias("base_labels"), joined(F.col("license_matches")).alias("labels"), score.alias("score"))
