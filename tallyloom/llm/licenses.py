r"""License scans: a generalised suffix automaton of licence words, matching statistics, and chains of long matches.

The automaton holds the words of every template. A text's words stream through it: at each word, the length of the longest
run that ends there and stands in some template, and along the suffix links every template and place where a shorter run stands.
Runs of LEAST words or more that no place's own template extends on either side are anchors, so that a template within another
one has its own; anchors of a template whose places go forward in both, with gaps of at most GAP words, make a chain. Chains that
cover COVER of their template give its label: the heaviest one, then those beside it that share no word with it. Names of licences
are templates that must stand word for word; one within a longer one or within a chain of its label is not reported. The base phrases are found whole.
SPDX identifiers are read after `spdx license identifier`: the longest known one, and those that `or` and `and` add.

Templates are opening words, notices and whole texts of public licences; others can be given as a list or table of texts and
labels (texts_of() makes one of a folder of licence texts), MOST_TEMPLATE_WORDS words at most, as every task holds them. Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased. Null and empty texts have none. Repeated rows are each scanned. Kept columns with the name of a result go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import col, map_texts, others, words_of

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Opening or notice words of public licences.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("copyright all rights reserved no part of this publication may be reproduced", "reserved"),
    (
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
        in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
        of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any
        kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event
        shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising
        from out of or in connection with the software or the use or other dealings in the software""",
        "mit",
    ),
    (
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary
        form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any
        express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are
        disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential
        damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused
        and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this
        software even if advised of the possibility of such damage""",
        "bsd-3-clause",
    ),
    (
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
        notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this
        software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or
        consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
        tortious action arising out of or in connection with the use or performance of this software""",
        "isc",
    ),
    (
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the
        use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote
        the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2
        altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed
        or altered from any source distribution""",
        "zlib",
    ),
    (
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that
        recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make
        this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law""",
        "unlicense",
    ),
)
# Names of licences as notices give them, LEAST words or more each.
NAMES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("apache license version 2 0", "apache-2.0"),
    ("apache license v2 0", "apache-2.0"),
    ("apache license 2 0", "apache-2.0"),
    ("apache software license version 2 0", "apache-2.0"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("mozilla public license v2 0", "mpl-2.0"),
    ("mozilla public license 2 0", "mpl-2.0"),
    ("mozilla public license version 1 1", "mpl-1.1"),
    ("eclipse public license version 1 0", "epl-1.0"),
    ("eclipse public license v1 0", "epl-1.0"),
    ("eclipse public license version 2 0", "epl-2.0"),
    ("eclipse public license v2 0", "epl-2.0"),
    ("eclipse public license 2 0", "epl-2.0"),
    ("boost software license version 1 0", "bsl-1.0"),
    ("common development and distribution license", "cddl"),
    ("european union public licence", "eupl"),
    ("sil open font license", "ofl"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution non commercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("creative commons attribution no derivatives", "cc-by-nd"),
    ("creative commons zero v1 0", "cc0-1.0"),
    ("licensed under the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("distributed under the mit license", "mit"),
    ("the terms of the mit license", "mit"),
    ("licensed under the bsd license", "bsd"),
    ("released under the bsd license", "bsd"),
)
# Identifiers of the SPDX licence list that are most in use; in lower case they are labels.
SPDX = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0
CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 EPL-1.0 EPL-2.0 EUPL-1.2
GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC
LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later
MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL PSF-2.0 Python-2.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""
SPDX_MARK = "spdx license identifier"
#: Words of all templates, at most.
MOST_TEMPLATE_WORDS = 1_000_000
#: Words of the shortest anchor, words between anchors of a chain, and the part of a template that a chain must cover.
LEAST, GAP, COVER = 4, 8, 0.75

SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("cover", T.DoubleType())])
OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("base", T.ArrayType(SPAN)), T.StructField("chains", T.ArrayType(SPAN))])


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; ends[state] has (sequence, place) of every end of its runs of `least` words or more."""

    def __init__(self, sequences: list[list[int]], least: int = LEAST) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((t, place))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] >= least:
                self.ends[self.link[s]] |= self.ends[s]
        self.least, self._steps = least, {}

    def steps(self, s: int) -> list[tuple[int, list[tuple[int, int]]]]:
        """(words, ends) of a state's runs and of those its suffix links lead to: the ends where no longer run of the state ends, sorted."""
        if s not in self._steps:
            got, at = [(self.length[s], sorted(self.ends[s]))], s
            while self.length[self.link[at]] >= self.least:
                at, below = self.link[at], at
                got.append((self.length[at], sorted(self.ends[at] - self.ends[below])))
            self._steps[s] = got
        return self._steps[s]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, above: int, word: int) -> int:
        """The state of the longest run that `above` and `word` make; a copy takes the shorter runs of a longer one."""
        old = self.next[above][word]
        if self.length[old] == self.length[above] + 1:
            return old
        new = self._state(self.length[above] + 1)
        self.next[new], self.link[new], self.link[old] = dict(self.next[old]), self.link[old], new
        while above >= 0 and self.next[above].get(word) == old:
            self.next[above][word] = new
            above = self.link[above]
        return new

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, s = self._state(self.length[last] + 1), last
        while s >= 0 and word not in self.next[s]:
            self.next[s][word] = new
            s = self.link[s]
        self.link[new] = self._split(s, word) if s >= 0 else 0
        return new

    def statistics(self, words: list[int]):
        """(length, state) of the longest run of the templates that ends at each word."""
        s = n = 0
        for word in words:
            while s and word not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if word in self.next[s]:
                s = self.next[s][word]
                n += 1
            yield n, s


def _identifiers() -> dict[tuple[bytes, ...], str]:
    """SPDX identifiers by their words."""
    return {tuple(words_of(x.lower().encode())): x.lower() for x in SPDX.split()}


def _expression(words: list[bytes], at: int, known: dict[tuple[bytes, ...], str]) -> list[dict]:
    """The identifiers of an SPDX expression that begins at a word."""
    out, most = [], max(map(len, known))
    while True:
        n = next((n for n in range(most, 0, -1) if tuple(words[at : at + n]) in known), 0)
        if not n:
            return out
        out.append({"label": known[tuple(words[at : at + n])], "first": at, "last": at + n - 1, "cover": 1.0})
        at += n
        if words[at : at + 1] not in ([b"or"], [b"and"]):
            return out
        at += 1


def scanner(given: tuple[tuple[str, str], ...] = TEMPLATES, names: tuple[tuple[str, str], ...] = ()):
    """A function from texts to the columns of OUT, for templates and names of texts and labels."""
    vocabulary: dict[bytes, int] = {}
    number = lambda text: [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text.encode())]
    phrases = [(number(p), label) for p, label in BASE]
    templates = [(number(p), label, False) for p, label in given] + [(number(p), label, True) for p, label in names]
    mark, known = number(SPDX_MARK), _identifiers()
    automaton = SuffixAutomaton([p for p, *_ in templates])
    # runs of LEAST words that stand in a template: the automaton's anchors lie around these
    grams = np.unique(np.concatenate([np.zeros(0, np.int64), *(_key(np.array(p, np.int64)) for p, *_ in templates if len(p) >= LEAST)]))

    def scan(texts: list[bytes]) -> dict:
        words = [words_of(t) for t in texts]
        sizes = [len(w) for w in words]
        starts = np.concatenate(([0], np.cumsum([n + 1 for n in sizes])))
        get = vocabulary.get
        ids = np.zeros(int(starts[-1]) + LEAST, np.int64)  # a 0 after each text keeps runs apart
        for w, at in zip(words, starts.tolist(), strict=False):
            ids[at : at + len(w)] = [get(x, 0) for x in w]
        base: list[list[dict]] = [[] for _ in texts]
        chains: list[list[dict]] = [[] for _ in texts]


        def places(phrase: list[int]):
            hit = np.ones(len(ids) - len(phrase) + 1, bool)
            for k, p in enumerate(phrase):
                hit &= ids[k : k + len(hit)] == p
            for at in np.flatnonzero(hit):
                d = int(np.searchsorted(starts, at, "right")) - 1
                yield d, int(at - starts[d])

        for phrase, label in phrases:
            for d, at in places(phrase):
                base[d].append({"label": label, "first": at, "last": at + len(phrase) - 1, "cover": 1.0})
        seeds = np.flatnonzero(np.isin(_key(ids), grams))
        for lo, hi, d in _regions(seeds, np.searchsorted(starts, seeds, "right") - 1):
            chains[d] += _chains(automaton, templates, ids[lo:hi].tolist(), lo - int(starts[d]))
        for d, at in places(mark):
            chains[d] += _expression(words[d], at + len(mark), known)
        order = lambda s: (s["first"], s["label"], s["last"])
        return {"n_words": sizes, "base": [sorted(b, key=order) for b in base], "chains": [sorted(c, key=order) for c in chains]}

    return scan


def _key(ids: np.ndarray) -> np.ndarray:
    """A number for each run of LEAST words; template words are few, so these do not clash."""
    n = len(ids) - LEAST + 1
    key = np.zeros(n, np.int64)
    for k in range(LEAST):
        key = key << 15 | ids[k : k + n]
    return key


def _regions(seeds: np.ndarray, texts: np.ndarray) -> list[tuple[int, int, int]]:
    """Ranges of words, with their text, that hold the seeds which one chain could join."""
    out: list[tuple[int, int, int]] = []
    for s, d in zip(seeds.tolist(), texts.tolist(), strict=True):
        if out and out[-1][2] == d and s <= out[-1][1] + GAP:
            out[-1] = (out[-1][0], s + LEAST, d)
        else:
            out.append((s, s + LEAST, d))
    return out


def _chains(automaton: SuffixAutomaton, templates, words: list[int], offset: int) -> list[dict]:
    """The chains of one region that cover enough of their template."""
    anchors: dict[int, list[tuple[int, int, int]]] = {}
    for i, (n, s) in enumerate(automaton.statistics(words)):
        if n < LEAST:
            continue
        after = words[i + 1] if i + 1 < len(words) else None
        for size, ends in automaton.steps(s):
            size = min(n, size)
            for t, place in ends:
                template = templates[t][0]
                if place + 1 == len(template) or template[place + 1] != after:
                    anchors.setdefault(t, []).append((i - size + 1, place - size + 1, size))
    out, whole = [], []
    for t, found in anchors.items():
        template, label, is_name = templates[t]
        if is_name:
            whole += [{"label": label, "first": offset + a, "last": offset + a + n - 1, "cover": 1.0} for a, _, n in found if n == len(template)]
            continue
        open_ = _apart(found)
        while open_:  # the heaviest chain, then those on both sides of it
            rest = open_.pop()
            weight, first, last = _heaviest(rest)
            if weight >= COVER * len(template):
                out.append({"label": label, "first": offset + first, "last": offset + last, "cover": weight / len(template)})
                sides = [x for x in rest if x[0] + x[2] <= first], [x for x in rest if x[0] > last]
                open_ += [side for side in sides if side]
    # a name within a longer name, or within a chain of its own label, says nothing new
    reach, covered = -1, {}
    for is_name, span in sorted([*((False, c) for c in out), *((True, c) for c in whole)], key=lambda s: (s[1]["first"], -s[1]["last"], s[0])):
        if is_name:
            if span["last"] > max(reach, covered.get(span["label"], -1)):
                out.append(span)
            reach = max(reach, span["last"])
        else:
            covered[span["label"]] = max(covered.get(span["label"], -1), span["last"])
    return out


def _apart(anchors: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The anchors (by their ends) in groups that share no word and between which no chain goes, so that a text of many notices is not searched whole for each."""
    spans = []  # from the first anchor that one may follow to its own end
    for k, (a, b, n) in enumerate(anchors):
        first = a
        for j in range(k - 1, -1, -1):
            x, y, m = anchors[j]
            if a - x - m > GAP:
                break
            if x + m <= a and y + m <= b:
                first = min(first, x)
        spans.append((first, a + n, k))
    out, reach = [], -1
    for first, end, k in sorted(spans):
        if first >= reach:
            out.append([])
        out[-1].append(k)
        reach = max(reach, end)
    return [[anchors[k] for k in sorted(group)] for group in out]


def _heaviest(anchors: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Words, first and last place of the heaviest chain of anchors (place in the text, in the template, words) that go forward in both."""
    best: list[tuple[int, int]] = []
    for k, (a, b, n) in enumerate(anchors):
        value, back = n, -1
        for j in range(k - 1, -1, -1):
            x, y, m = anchors[j]
            if a - x - m > GAP:  # anchors come by their ends in the text
                break
            if x + m <= a and y + m <= b and best[j][0] + n > value:
                value, back = best[j][0] + n, j
        best.append((value, back))
    k = max(range(len(best)), key=lambda k: best[k][0])
    weight, last = best[k][0], anchors[k][0] + anchors[k][2] - 1
    while best[k][1] >= 0:
        k = best[k][1]
    return weight, anchors[k][0], last


def checked(templates) -> tuple[tuple[str, str], ...]:
    """Templates from a list, or from a table (text, label) whose size is checked before it is read."""
    if isinstance(templates, DataFrame):
        size = templates.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        if size > 12 * MOST_TEMPLATE_WORDS:
            raise ValueError(f"templates of {size} characters: a task holds at most {12 * MOST_TEMPLATE_WORDS}")
        templates = [(r.text, r.label) for r in templates.where("text is not null and label is not null").select("text", "label").collect()]
    return tuple((str(t), str(label)) for t, label in templates)


def texts_of(spark: SparkSession, folder: str) -> DataFrame:
    """A table of templates (text, label) of a folder's files, whole licence texts each, labelled by their names in lower case."""
    files = spark.read.text(folder, wholetext=True)
    return files.select(F.col("value").alias("text"), F.lower(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt$", "")).alias("label"))


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates=TEMPLATES, names=None) -> DataFrame:
    """The columns `keep` of docs (all but the text, if None), n_words, base (phrase places) and chains (spans of covered templates,
    names and SPDX identifiers). Names are a list like templates; by default NAMES beside the default templates, and none beside others."""
    given, named = checked(templates), checked((NAMES if templates is TEMPLATES else ()) if names is None else names)
    return map_texts(docs, text_col, others(docs, text_col) if keep is None else keep, OUT, lambda: scanner(given, named))


def digest(found: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score per row of find()."""
    labels = lambda *spans: F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat(*spans), lambda s: s["label"]))), ",")
    firsts = F.transform("base", lambda s: s["first"])
    rest = [col(c) for c in found.columns if c not in OUT.names]
    score = F.coalesce(F.array_max(F.transform(F.concat("base", "chains"), lambda s: s["cover"])), F.lit(0.0))
    return found.select(*rest, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"), labels("base").alias("base_labels"), labels("base", "chains").alias("labels"), score.alias("score"))
