"""License scan: ordered signature rules over a text's words, gated by keywords, overlaps settled by priority and containment.

A rule is written over a text's words (lower case, each followed by one space)
in a small form of regular expression: ``a|b`` is either word, and ``a?`` or
``a|b?`` may be missing. The words that must stand there whatever matches are the
rule's keywords; a rule is only tried on texts that hold all of them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.store import id_of, keyed, returning_memory


@dataclass(frozen=True)
class Rule:
    """What names a license. A lower ``rank`` goes first; the places of a base rule are never suppressed."""

    label: str
    pattern: str
    rank: int
    weight: float
    base: bool = False

    @cached_property
    def keywords(self) -> frozenset[bytes]:
        return frozenset(x.encode() for x in self.pattern.split() if not set("|?") & set(x))

    @cached_property
    def regex(self) -> re.Pattern[bytes]:
        items = (f"(?:(?:{x[:-1]}) )?" if x.endswith("?") else f"(?:{x}) " for x in self.pattern.split())
        return re.compile(b"(?<![^ ])" + "".join(items).encode())


# Base phrases, each with the label that it gives.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

# Signatures by rank. Whole notices and identifiers come first, then names with
# a version, then bare names and links, then general remarks. A line is
# ``label: pattern``; several patterns of a label are separated by `` / ``.
NOTICES = """
mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files / the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
isc: permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd: permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd: redistribution and use in source and binary forms with or without modification are permitted / redistributions of source code must retain the above copyright notice / redistributions in binary form must reproduce the above copyright notice
bsd-3-clause: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products / the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2.0: licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license / you may obtain a copy of the license at http www apache org licenses license 2 0
gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license / you should have received a copy of the gnu general public license along with this program
lgpl: this library is free software you can redistribute it and or modify it under the terms of the gnu lesser|library general public license / you should have received a copy of the gnu lesser|library general public license along with this library
agpl: this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license / you should have received a copy of the gnu affero general public license
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0: this source code form is subject to the terms of the mozilla public license v 2 0 / if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
epl: this program and the accompanying materials are made available under the terms of the eclipse public license
cddl: the contents of this file are subject to the terms of the common development and distribution license
unlicense: this is free and unencumbered software released into the public domain
wtfpl: do what the fuck you want to public license / everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software / altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
artistic: the intent of this document is to state the conditions under which a package may be copied
ofl-1.1: this font software is licensed under the sil open font license version 1 1
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
python-2.0: this license agreement is between the python software foundation psf and the individual or organization
openssl: this product includes software developed by the openssl project for use in the openssl toolkit
cc0-1.0: to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights
cc-by-nc-nd: you may not use the material for commercial purposes and if you remix transform or build upon the material you may not distribute the modified material
cc-by-sa: if you remix transform or build upon the material you must distribute your contributions under the same license as the original
ncsa: developed by university of illinois at urbana champaign permission is hereby granted free of charge
beerware: as long as you retain this notice you can do whatever you want with this stuff if we meet some day
json: the software shall be used for good not evil
vim: vim is charityware you can use and copy it as much as you like
x11: except as contained in this notice the name of the x consortium shall not be used in advertising
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
ms-pl: this license governs use of the accompanying software if you use the software you accept this license
elastic-2.0: you may not provide the software to third parties as a hosted or managed service
sspl-1.0: if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
busl-1.1: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
"""

# Names of licenses with the versions that are written with them.
FAMILIES = """
gpl: gnu general public license version|v? {} / gnu gpl version|v? {} / gpl version|v? {} / gplv{} @ 1, 1.0, 2, 2.0, 3, 3.0
lgpl: gnu lesser|library general public license version|v? {} / gnu lgpl version|v? {} / lgpl version|v? {} / lgplv{} @ 2, 2.0, 2.1, 3, 3.0
agpl: gnu affero general public license version|v? {} / agpl version|v? {} / agplv{} @ 1, 3, 3.0
gfdl: gnu free documentation license version|v? {} / gfdl version|v? {} @ 1.1, 1.2, 1.3
apache: apache license version|v? {} / apache software license version|v? {} / apache public license version|v? {} / asl version|v? {} @ 1.0, 1.1, 2.0, 2
mpl: mozilla public license version|v? {} / mpl version|v? {} @ 1.0, 1.1, 2.0
epl: eclipse public license version|v? {} / epl version|v? {} @ 1.0, 2.0
cddl: common development and distribution license version|v? {} / cddl version|v? {} @ 1.0, 1.1
eupl: european union public licence|license version|v? {} / eupl version|v? {} @ 1.0, 1.1, 1.2
artistic: artistic license version|v? {} @ 1.0, 2.0
ofl: sil open font license version|v? {} / open font license version|v? {} @ 1.0, 1.1
bsl: boost software license version|v? {} @ 1.0
osl: open software license version|v? {} @ 1.0, 2.0, 2.1, 3.0
afl: academic free license version|v? {} @ 1.2, 2.0, 2.1, 3.0
cc-by: cc by version|v? {} / creative commons attribution version|v? {} @ 1.0, 2.0, 2.5, 3.0, 4.0
cc-by-sa: cc by sa version|v? {} / creative commons attribution sharealike version|v? {} @ 1.0, 2.0, 2.5, 3.0, 4.0
cc-by-nc: cc by nc version|v? {} / creative commons attribution noncommercial version|v? {} @ 1.0, 2.0, 2.5, 3.0, 4.0
cc-by-nd: cc by nd version|v? {} / creative commons attribution noderivs|noderivatives version|v? {} @ 1.0, 2.0, 2.5, 3.0, 4.0
cc-by-nc-sa: cc by nc sa version|v? {} / creative commons attribution noncommercial sharealike version|v? {} @ 1.0, 2.0, 2.5, 3.0, 4.0
cc-by-nc-nd: cc by nc nd version|v? {} / creative commons attribution noncommercial noderivs|noderivatives version|v? {} @ 1.0, 2.0, 2.5, 3.0, 4.0
odbl: open database license version|v? {} / odbl version|v? {} @ 1.0
"""

NAMES = """
gpl: gnu general public license / gnu public license / gnu gpl / general public license / gpl license / gpl licensed / under the gpl / gpl compatible
lgpl: gnu lesser|library general public license / lesser|library general public license / gnu lgpl / lgpl license / under the lgpl
agpl: gnu affero general public license / affero general public license / agpl license / under the agpl
gfdl: gnu free documentation license / free documentation license / gfdl
apache: apache license / apache software license / apache licensed / apache licence / under the apache
mit: mit license / mit licence / mit licensed / mit style license / expat license / under mit
bsd: bsd license / bsd licence / bsd licensed / bsd style license / under the bsd / berkeley software distribution license
bsd-2-clause: bsd 2 clause / 2 clause bsd / simplified bsd license / freebsd license / two clause bsd
bsd-3-clause: bsd 3 clause / 3 clause bsd / new bsd license / modified bsd license / revised bsd license / three clause bsd
bsd-4-clause: bsd 4 clause / 4 clause bsd / original bsd license / four clause bsd
isc: isc license / isc licence / isc licensed
mpl: mozilla public license / mozilla public licence
epl: eclipse public license
cpl: common public license
cddl: common development and distribution license
eupl: european union public license / european union public licence
unlicense: the unlicense / unlicense org
wtfpl: wtfpl
zlib: zlib license / zlib libpng license / libpng license
bsl-1.0: boost software license / boost license
artistic: artistic license / perl artistic license / same terms as perl itself
ofl: sil open font license / open font license / sil ofl
postgresql: postgresql license
python-2.0: python software foundation license / psf license / python license
openssl: openssl license / ssleay license
cc0-1.0: cc0 / cc zero / creative commons zero / creative commons cc0
cc-by: cc by / creative commons attribution / cc attribution
cc-by-sa: cc by sa / creative commons attribution sharealike / creative commons attribution share alike
cc-by-nc: cc by nc / creative commons attribution noncommercial / creative commons attribution non commercial
cc-by-nd: cc by nd / creative commons attribution noderivs / creative commons attribution noderivatives
cc-by-nc-sa: cc by nc sa / creative commons attribution noncommercial sharealike / creative commons attribution non commercial share alike
cc-by-nc-nd: cc by nc nd / creative commons attribution noncommercial noderivs / creative commons attribution non commercial no derivatives
creative-commons: creative commons license / creative commons licence / under creative commons / creative commons org licenses
odbl: open database license / odc open database license
odc-by: open data commons attribution license
pddl: public domain dedication and license
ncsa: university of illinois open source license / university of illinois ncsa open source license
ms-pl: microsoft public license / ms pl
ms-rl: microsoft reciprocal license / ms rl
qpl: q public license
ipl: ibm public license
osl: open software license
afl: academic free license
ecl: educational community license
lppl: latex project public license / lppl
zpl: zope public license
php: php license / php licence
ruby: ruby license / same terms as ruby
sspl-1.0: server side public license / sspl
busl-1.1: business source license / busl
elastic-2.0: elastic license
commons-clause: commons clause license condition / commons clause restriction
polyform: polyform noncommercial license / polyform small business license / polyform shield license
openrail: openrail m / open rail m / creativeml open rail / bigscience rail license / responsible ai license
llama: llama 2 community license / llama 3 community license / llama community license
ogl: open government licence / open government license
hippocratic: hippocratic license
anti-996: anti 996 license
mulan: mulan psl / mulan permissive software license
cecill: cecill / cea cnrs inria logiciel libre
nasa: nasa open source agreement
imagemagick: imagemagick license
"""

LINKS = """
apache-2.0: apache org licenses license 2 0 / opensource org licenses apache 2 0
mit: opensource org licenses mit / spdx org licenses mit / choosealicense com licenses mit
bsd: opensource org licenses bsd license
bsd-2-clause: opensource org licenses bsd 2 clause / spdx org licenses bsd 2 clause
bsd-3-clause: opensource org licenses bsd 3 clause / spdx org licenses bsd 3 clause
isc: opensource org licenses isc
gpl: gnu org licenses gpl / gnu org copyleft gpl / opensource org licenses gpl / gnu org licenses old licenses gpl 2 0
lgpl: gnu org licenses lgpl / gnu org copyleft lesser / opensource org licenses lgpl
agpl: gnu org licenses agpl / opensource org licenses agpl
gfdl: gnu org licenses fdl / gnu org copyleft fdl
mpl: mozilla org mpl / mozilla org en us mpl / opensource org licenses mpl
epl: eclipse org legal epl / opensource org licenses epl
cc0-1.0: creativecommons org publicdomain zero 1 0
public-domain: creativecommons org publicdomain mark 1 0 / creativecommons org licenses publicdomain
cc-by: creativecommons org licenses by
cc-by-sa: creativecommons org licenses by sa
cc-by-nc: creativecommons org licenses by nc
cc-by-nd: creativecommons org licenses by nd
cc-by-nc-sa: creativecommons org licenses by nc sa
cc-by-nc-nd: creativecommons org licenses by nc nd
unlicense: unlicense org
wtfpl: wtfpl net
bsl-1.0: boost org license 1 0 txt
ofl: scripts sil org ofl / openfontlicense org
odbl: opendatacommons org licenses odbl
odc-by: opendatacommons org licenses by
pddl: opendatacommons org licenses pddl
eupl: joinup ec europa eu software page eupl
artistic: perlfoundation org artistic license
zlib: zlib net zlib license / opensource org licenses zlib
"""

# Identifiers that stand after ``SPDX-License-Identifier:``, as words.
IDENTIFIERS = """
mit / mit 0 / apache 2 0 / apache 1 1 / bsd 2 clause / bsd 3 clause / bsd 4 clause / 0bsd / isc / zlib / unlicense / wtfpl / cc0 1 0 / bsl 1 0
gpl 1 0 / gpl 2 0 / gpl 2 0 only / gpl 2 0 or later / gpl 3 0 / gpl 3 0 only / gpl 3 0 or later / lgpl 2 0 only / lgpl 2 0 or later / lgpl 2 1
lgpl 2 1 only / lgpl 2 1 or later / lgpl 3 0 / lgpl 3 0 only / lgpl 3 0 or later / agpl 3 0 / agpl 3 0 only / agpl 3 0 or later
gfdl 1 2 or later / gfdl 1 3 only / gfdl 1 3 or later / mpl 1 1 / mpl 2 0 / epl 1 0 / epl 2 0 / cddl 1 0 / cddl 1 1 / eupl 1 1 / eupl 1 2 / cpl 1 0
artistic 1 0 / artistic 2 0 / ofl 1 1 / postgresql / python 2 0 / psf 2 0 / openssl / ncsa / ms pl / ms rl / osl 3 0 / afl 3 0 / ecl 2 0 / lppl 1 3c
zpl 2 1 / php 3 01 / ruby / sspl 1 0 / busl 1 1 / elastic 2 0 / cc by 3 0 / cc by 4 0 / cc by sa 3 0 / cc by sa 4 0 / cc by nc 4 0 / cc by nd 4 0
cc by nc sa 4 0 / cc by nc nd 4 0 / odbl 1 0 / odc by 1 0 / pddl 1 0 / upl 1 0 / vim / x11 / curl / json / beerware / mulanpsl 2 0 / cecill 2 1 / blueoak 1 0 0
"""

REMARKS = """
public-domain: released into the public domain / dedicated to the public domain / is in the public domain / placed in the public domain / public domain dedication / public domain work
all-rights-reserved: all rights reserved / tous droits réservés / alle rechte vorbehalten / todos los derechos reservados
copyright-notice: copyright c / copyright © / © copyright / copyright notice / copyright holder / copyright owner
proprietary: proprietary and confidential / strictly confidential / unauthorized copying of this file / proprietary license / commercial license / end user license agreement / may not be reproduced without the? prior? written permission / may not be copied without permission
no-warranty: provided as is without warranty of any kind / without any warranty without even the implied warranty / without warranties or conditions of any kind / distributed on an as is basis
non-commercial: for non commercial use only / non commercial use only / noncommercial use only / for personal use only / not for commercial use / non commercial purposes only
no-derivatives: no derivative works / no derivatives allowed
share-alike: share alike license / same or similar license
attribution: attribution required / please credit the author / credit must be given / with attribution to
see-license: see license file|txt|md / see the license file / see the accompanying license / license file for details / full license text / see license for details
open-source: open source license / open source licence / free software license / osi approved license / permissive license / copyleft license
terms-of-use: terms of use / terms of service / terms and conditions apply
reuse: licensed under the same terms / dual licensed under / multi licensed under / reprinted with permission / used by permission / used with permission
"""


def entries(table: str) -> Iterator[tuple[str, str]]:
    for line in table.strip().splitlines():
        label, patterns = line.split(": ", 1)
        for pattern in patterns.split(" / "):
            yield label, pattern


def license_rules() -> tuple[Rule, ...]:
    """The signatures of this module, in order."""
    rules = [Rule(label, phrase, 0, 0.9, base=True) for label, phrase in BASE]
    rules += [Rule(label, pattern, 1, 0.99) for label, pattern in entries(NOTICES)]
    for line in IDENTIFIERS.strip().splitlines():
        rules += [Rule(name.replace(" ", "-"), f"spdx license identifier {name}", 1, 0.99) for name in line.split(" / ")]
    for line in FAMILIES.strip().splitlines():
        names, versions = line.split(" @ ")
        for label, pattern in entries(names):
            for version in versions.split(", "):
                full = version if "." in version else f"{version}.0"
                rules.append(Rule(f"{label}-{full}", pattern.format(version.replace(".", " ")), 2, 0.95))
    rules += [Rule(label, pattern, 2, 0.95) for label, pattern in entries(LINKS)]
    rules += [Rule(label, pattern, 3, 0.8) for label, pattern in entries(NAMES)]
    rules += [Rule(label, pattern, 4, 0.4) for label, pattern in entries(REMARKS)]
    return tuple(rules)


#: What is no word once A-Z are lower case becomes a space; bytes from 0x80 on belong to words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

Place = tuple[int, int, int]  # first byte, end byte, number of the rule


class Scanner:
    """Rules by a keyword that few of them share, so that most texts are through after one look at their words."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = rules
        for rule in rules:
            if not rule.keywords:
                raise ValueError(f"rule without a word that must stand there: {rule.pattern!r}")
        shared: dict[bytes, int] = defaultdict(int)
        for rule in rules:
            for word in rule.keywords:
                shared[word] += 1
        self.by_anchor: dict[bytes, list[int]] = defaultdict(list)
        for number, rule in enumerate(rules):
            self.by_anchor[min(rule.keywords, key=lambda w: (shared[w], -len(w), w))].append(number)
        self.anchors, self.keywords = frozenset(self.by_anchor), frozenset(shared)

    def places(self, words: list[bytes]) -> list[Place]:
        """All matches of all rules whose keywords a text has."""
        anchors = self.anchors.intersection(words)
        if not anchors:
            return []
        have, line = self.keywords.intersection(words), b" ".join(words) + b" "
        return [
            (m.start(), m.end(), number)
            for anchor in anchors for number in self.by_anchor[anchor] if self.rules[number].keywords <= have
            for m in self.rules[number].regex.finditer(line)
        ]

    def kept(self, places: list[Place]) -> list[Place]:
        """Places that no other one of the same or a better rank contains; of equal ones the first rule's. Base places stay."""
        order = sorted(places, key=lambda p: (p[0], -p[1], self.rules[p[2]].rank, p[2]))
        reach: dict[int, int] = {}  # the farthest end so far, by rank
        out = []
        for first, end, number in order:
            rule = self.rules[number]
            if rule.base or not any(rank <= rule.rank and to >= end for rank, to in reach.items()):
                out.append((first, end, number))
            reach[rule.rank] = max(reach.get(rule.rank, 0), end)
        return out

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and (first word, end word, rule) of each kept place, in order."""
        words = text.translate(WORDS).split()
        kept = self.kept(self.places(words))
        if not kept:
            return len(words), []
        line, at, word, found = b" ".join(words) + b" ", 0, 0, []
        for first, end, number in kept:  # in order of their first byte
            word += line.count(b" ", at, first)
            at = first
            found.append((word, word + line.count(b" ", first, end), number))
        return len(words), found


FOUND = "array<struct<label: string, first: long, end: long, weight: double, base: boolean>>"
PLACE = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()), ("base", pa.bool_())])


@returning_memory
def scan_batches(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules)
    for batch in batches:
        n_words, found, labels, scores = [], [], [], []
        for text in batch.column("text"):
            n, places = scanner.scan(text.as_buffer().to_pybytes() if text.is_valid else b"")
            weights: dict[str, float] = {}
            for _, _, number in places:
                rule = rules[number]
                weights[rule.label] = max(weights.get(rule.label, 0.0), rule.weight)
            doubt = 1.0
            for label in sorted(weights):
                doubt *= 1 - weights[label]
            n_words.append(n)
            found.append([(rules[i].label, first, end, rules[i].weight, rules[i].base) for first, end, i in places])
            labels.append(sorted(weights))
            scores.append(1 - doubt)
        names = [f.name for f in PLACE]
        rows = [[dict(zip(names, p, strict=True)) for p in mine] for mine in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"), batch.column("mark"), pa.array(n_words, pa.int64()), pa.array(rows, pa.list_(PLACE)),
                pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64()),
            ],
            names=["key", "mark", "n_words", "found", "labels", "score"],
        )


def scan_licenses(documents: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, found, labels, score and mark of the text, one row per input row.

    ``found`` lists the places that count: label, first and end word, the rule's
    weight and whether it is a base rule. A place that lies within another one of
    the same or a better rank is suppressed (of equal ones the later rule's);
    base places stay. ``labels`` are the distinct labels found, sorted; ``score``
    is 1 less the product of (1 - weight) over them, 0 without any.

    Words are runs of digits, letters a-z once A-Z are lower case, and all that is
    not ASCII. Null and empty texts have no words. A document is scanned by itself
    and whole, so there is no shuffle. Null ids and repeated rows are documents
    like others; other columns are not read.
    """
    rules = tuple(rules) if rules is not None else license_rules()
    schema = f"key long, mark long, n_words long, found {FOUND}, labels array<string>, score double"
    out = keyed(documents).mapInArrow(lambda b: scan_batches(b, rules), schema)
    return out.select(id_of(F.col("key")).alias("doc_id"), "n_words", "found", "labels", "score", "mark")
