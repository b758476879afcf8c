"""License scans: license templates with optional and replaceable regions as automata over words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from quillwork.llm._rows import map_text, words_of

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Passages that several licenses share.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
)
_MIT_NOTICE = "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
_MIT_END = f"{_AS_IS} and noninfringement in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_GRANT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {1} redistributions of source code must retain the above "
    "copyright notice this list of conditions and the following disclaimer {1} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution"
)
_BSD_ADVERTS = "{1} all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {12}"
_BSD_NAMES = "{1} neither the name of {10} nor the names of {6} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AUTHOR = "{1} the name of {6} may not be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = (
    "this software is provided by {10} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {10} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data "
    "or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of "
    "this software even if advised of the possibility of such damage"
)
_ISC_GRANT = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    "the software is provided as is and {6} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {8} be liable for any special "
    "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
    "connection with the use or performance of this software"
)
_GNU = (
    "is free software you can redistribute it and or modify it under the terms of {0} as published by the free software foundation either version {{2}} of the license or at your option any later version "
    "{{2}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see {0} for more details"
)

#: Template texts by label. `[[...]]` may be missing, `{n}` stands for up to n words of any kind, all
#: other words must stand exactly so. `{!a,b}` at the end: none of these words may follow. Case and punctuation
#: don't count.
TEMPLATES = (
    # whole texts
    ("mit", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_END} {{!except}}"),
    ("x11", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_END} except as contained in this notice the name {{12}} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from {{6}}"),
    ("mit-0", f"{_MIT_GRANT} {_MIT_END}"),
    ("json", f"{_MIT_GRANT} {_MIT_NOTICE} the software shall be used for good not evil {_MIT_END}"),
    ("isc", f"{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}"),
    ("0bsd", f"{_ISC_GRANT} {_ISC_END}"),
    ("bsd-2-clause", f"{_BSD_GRANT} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_GRANT} {_BSD_AUTHOR} {_BSD_END}"),
    ("bsd-4-clause", f"{_BSD_GRANT} {_BSD_ADVERTS} {_BSD_NAMES} {_BSD_END}"),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will {6} be held liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions {1} the origin of this software must not be misrepresented you must "
        "not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {1} altered source versions must be "
        "plainly marked as such and must not be misrepresented as being the original software {1} this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for "
        "any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all "
        f"present and future rights to this software under copyright law {_MIT_END}",
    ),
    (
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute "
        "execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the "
        "software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of "
        "the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor "
        f"{_AS_IS} title and non infringement in no event shall {{10}} be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    # notices that stand for a whole text
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this {2} except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the "
        "license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl", _GNU.format("the gnu general public license")),
    ("lgpl", _GNU.format("the gnu lesser general public license")),
    ("agpl", _GNU.format("the gnu affero general public license")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"),
    # names in running text
    ("mit", "licensed under [[the terms of]] the [[x11]] mit [[open source]] licen[cs]e"),
    ("mit", "released under [[the terms of]] the mit licen[cs]e"),
    ("apache-2", "licensed under the apache license [[version]] 2 [[0]]"),
    ("cc-by-nc", "creative commons attribution [[and]] non commercial [[{3}]] licen[cs]e"),
    ("cc-by-nc", "creative commons attribution noncommercial [[{3}]] licen[cs]e"),
    ("cc-by", "licensed under [[a]] cc by {!nc,sa,nd}"),
    ("cc-by-sa", "licensed under [[a]] cc by sa"),
    ("cc-by-nd", "licensed under [[a]] cc by nd"),
    ("cc-by-nc", "licensed under [[a]] cc by nc {!sa,nd}"),
    ("cc-by-nc-sa", "cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd"),
    ("gpl", "gnu general public license [[as published by the free software foundation]] [[either]] version {1}"),
    ("gpl", "licensed under the [[terms of the]] gnu general public licen[cs]e"),
    ("lgpl", "gnu [[lesser]] [[library]] general public license [[as published by the free software foundation]] [[either]] version {1}"),
    ("lgpl", "licensed under the [[terms of the]] gnu lesser general public licen[cs]e"),
    ("agpl", "gnu affero general public licen[cs]e [[version]] [[3]]"),
)
#: Identifiers after "SPDX-License-Identifier:" and their labels; of those that match, the longest counts.
SPDX = (
    ("mit", "mit"), ("mit 0", "mit-0"), ("mit advertising", "mit-advertising"), ("mit cmu", "mit-cmu"), ("mit enna", "mit-enna"), ("mit feh", "mit-feh"), ("mit festival", "mit-festival"),
    ("mit khronos old", "mit-khronos-old"), ("mit modern variant", "mit-modern-variant"), ("mit open group", "mit-open-group"), ("mit testregex", "mit-testregex"), ("mit wu", "mit-wu"), ("x11", "x11"), ("json", "json"),
    ("apache 1 0", "apache-1"), ("apache 1 1", "apache-1"), ("apache 2 0", "apache-2"), ("isc", "isc"), ("0bsd", "0bsd"), ("bsd 2 clause", "bsd-2-clause"), ("bsd 3 clause", "bsd-3-clause"), ("bsd 4 clause", "bsd-4-clause"),
    ("zlib", "zlib"), ("unlicense", "unlicense"), ("bsl 1 0", "bsl-1"), ("mpl 1 1", "mpl-1"), ("mpl 2 0", "mpl-2"), ("epl 1 0", "epl-1"), ("epl 2 0", "epl-2"), ("cc0 1 0", "cc0"),
    *((f"{x} {v} {k}", x) for x, vs in (("gpl", ("1 0", "2 0", "3 0")), ("lgpl", ("2 0", "2 1", "3 0")), ("agpl", ("1 0", "3 0"))) for v in vs for k in ("only", "or later")),
    *((f"{x} {v}", x) for x, vs in (("gpl", ("1 0", "2 0", "3 0")), ("lgpl", ("2 0", "2 1", "3 0")), ("agpl", ("1 0", "3 0"))) for v in vs),
    *((f"cc {x.replace('-', ' ')} {v} 0", f"cc-{x}") for x in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in (1, 2, 3, 4)),
)

_PART = re.compile(r"\[\[|\]\]|\{\d+\}|\{![\w,]+\}|[^\s\[\]{}]*(?:\[\w+\][^\s\[\]{}]*)+|[^\s\[\]{}]+")


@dataclass
class TokenAutomaton:
    """One template. State i waits for part i; `skip[i]` are the states that i passes to without a word.

    A part is a word, a set of words, or None, which takes any word. Optional parts and every word of a
    replaceable region can be skipped, so a text is taken exactly if its mandatory words stand in order
    with nothing between them but what the template allows, and none of the words `bars` after them.
    """

    label: str
    parts: list = field(default_factory=list)
    skip: list = field(default_factory=list)
    bars: frozenset = frozenset()

    @classmethod
    def of(cls, label: str, template: str) -> TokenAutomaton:
        self, opened, jumps = cls(label), [], []
        for x in _PART.findall(template):
            if x == "[[":
                opened.append(len(self.parts))
            elif x == "]]":
                jumps.append((opened.pop(), len(self.parts)))
            elif x[:2] == "{!":
                self.bars = frozenset(w.encode() for w in x[2:-1].split(","))
            elif x[0] == "{":
                for _ in range(int(x[1:-1])):
                    jumps.append((len(self.parts), len(self.parts) + 1))
                    self.parts.append(None)
            elif "[" in x:
                head, letters, tail = re.fullmatch(r"(\w*)\[(\w+)\](\w*)", x).groups()
                self.parts.append(frozenset(f"{head}{c}{tail}".encode() for c in letters))
            else:
                self.parts.append(frozenset([x.encode()]))
        n = len(self.parts)
        reach = [{i} for i in range(n + 1)]
        for i in range(n, -1, -1):
            for a, b in jumps:
                if a == i:
                    reach[i] |= reach[b]
        self.skip = [tuple(sorted(r)) for r in reach]
        inside = {i for a, b in jumps for i in range(a, b)}
        self.mandatory = [p for i, p in enumerate(self.parts) if i not in inside]
        self.first = frozenset(w for i in self.skip[0] if i < n and self.parts[i] for w in self.parts[i])
        return self

    def match(self, words: list[bytes], start: int) -> int:
        """End of the longest text that begins at word `start`, or -1."""
        n, end, now = len(self.parts), -1, set(self.skip[0])
        at = start
        while now:
            if n in now and not (at < len(words) and words[at] in self.bars):
                end = at
            if at >= len(words):
                break
            w = words[at]
            now = {j for i in now if i < n and (self.parts[i] is None or w in self.parts[i]) for j in self.skip[i + 1]}
            at += 1
        return end


class Scanner:
    """All templates together; a template is tried only where a text has each of its mandatory words."""

    def __init__(self, base=BASE, templates=TEMPLATES, spdx=SPDX):
        self.base = [TokenAutomaton.of(label, t) for t, label in base]
        self.more = [TokenAutomaton.of(label, t) for label, t in templates]
        self.spdx = [TokenAutomaton.of(label, f"spdx license identifier {t}") for t, label in spdx]
        #: any text with a match holds one of these: for each template, its longest mandatory word
        self.anchors = frozenset(w for t in self.base + self.more + self.spdx for w in max(t.mandatory, key=lambda p: (max(map(len, p)), sorted(p))))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Base places (first word, end, label), and the templates' places with a strength from 0 to 1."""
        if self.anchors.isdisjoint(words):
            return [], []
        there = set(words)
        places: dict[bytes, list[int]] = {}
        base, more, named = [], [], {}
        for out, autos in ((base, self.base), (more, self.more), (named, self.spdx if b"spdx" in there else ())):
            for auto in autos:
                if any(p.isdisjoint(there) for p in auto.mandatory):
                    continue
                if not places:
                    for i, w in enumerate(words):
                        places.setdefault(w, []).append(i)
                for i in sorted(i for w in auto.first for i in places.get(w, ())):
                    end = auto.match(words, i)
                    if end >= 0:
                        n = len(auto.mandatory)
                        if out is named:
                            named[i] = max(named.get(i, (0,)), (end, auto.label, n / (n + 2)))
                        else:
                            out.append((i, end, auto.label) if out is base else (i, end, auto.label, n / (n + 2)))
        return sorted(base), sorted(more + [(i, *found) for i, found in named.items()])


_PLACES = ArrayType(StructType([StructField("from", LongType()), StructField("to", LongType()), StructField("label", StringType()), StructField("base", LongType())]))
FIELDS = [
    StructField("lic_n_words", LongType()),
    StructField("lic_n_base", LongType()),
    StructField("lic_first", LongType()),
    StructField("lic_last", LongType()),
    StructField("lic_base_labels", StringType()),
    StructField("lic_labels", StringType()),
    StructField("lic_score", DoubleType()),
    StructField("lic_places", _PLACES),
]


def scan(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, and the license finds of each row: lic_places with word positions and labels, labels,
    counts, and lic_score, the chance that not every place is there by accident: 1 - prod(1 - n / (n + 2))
    over the labels, n the most mandatory words matched for one.

    Null and empty texts have no words and score 0. Overlapping places all count. Rows stay one for one.
    """

    def factory():
        scanner = Scanner()

        def work(texts):
            cols: list[list] = [[] for _ in FIELDS]
            for t in texts:
                words = words_of(t) if t else []
                base, more = scanner.scan(words)
                best: dict[str, float] = {}
                for a, b, label, *strength in [*base, *more]:
                    best[label] = max(best.get(label, 0.0), strength[0] if strength else (b - a) / (b - a + 2))
                miss = 1.0
                for label in sorted(best):
                    miss *= 1 - best[label]
                starts = [x[0] for x in base]
                places = [{"from": a, "to": b, "label": label, "base": 1} for a, b, label in base] + [{"from": a, "to": b, "label": label, "base": 0} for a, b, label, _ in more]
                row = (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[2] for x in base})), ",".join(sorted(best)), 1 - miss, places)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return cols

        return work

    keep = [c for c in keep if c.lower() not in {f.name for f in FIELDS}]  # results replace columns of their names
    return map_text(documents, text, keep, FIELDS, factory)


def contract(documents: DataFrame) -> DataFrame:
    """One row per document for op10."""
    names = {"lic_first": "first_word", "lic_last": "last_word"}
    out = scan(documents, ["doc_id"]).drop("lic_places")
    return out.toDF(*[names.get(c, c.removeprefix("lic_")) for c in out.columns])
