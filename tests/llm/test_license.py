import random
import re
from re import _constants, _parser

from paperloom.llm import license as L


def detections(text):
    """What stays of all rules' matches, from the definition: every rule on every text, every pair of matches compared."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm = " " + "  ".join(words) + " " if words else " "
    found = [(m.start(), m.end(), rank, label) for rank, (label, _, e) in enumerate(L.rules()) for m in re.finditer(L.spaced(e), norm)]
    return words, resolve(found)


def resolve(found):
    def inside(d, e):
        return e[0] <= d[0] and d[1] <= e[1] and ((d[0], d[1]) != (e[0], e[1]) or e[2] < d[2])

    outer = [d for d in found if not any(inside(d, e) for e in found)]
    kept = []
    for d in sorted(outer, key=lambda d: (d[2], d[0])):
        if not any(d[0] < e[1] and e[0] < d[1] for e in kept):
            kept.append(d)
    return kept


def brute(text):
    words, kept = detections(text)
    places = [(k, label) for p, label in L.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    base = sorted({label for _, label in places})
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(set(base) | {d[3] for d in kept})), len(kept)


PARTS = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "GNU Lesser General Public License v2.1 or later", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "SPDX-License-Identifier: GPL-3.0-only", "All rights reserved", "Mozilla Public License 2.0",
    "cc by nc cc by nc nd", "under the mit license under the mit license", "the BSD 3-clause license", "do good", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "freebsd license", "für nichts", "noncommercial use only",
]


def test_agrees_with_brute_force(spark, docs):
    rnd = random.Random(4)
    texts = [None, "", " .,; ", "ÄÖ ü1", *PARTS, "x " * 40_000 + PARTS[1], *(" ".join(rnd.choice(PARTS) for _ in range(rnd.randrange(1, 7))) for _ in range(60)), "; ".join(PARTS * 20)]
    rows = list(enumerate(texts)) + [(None, PARTS[0]), (3, "ÄÖ ü1")]
    got = sorted(((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.n_detections)) for r in L.scan(docs(rows)).collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_priority_and_containment(docs):
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(docs([(1, "GNU GPL v3 or later"), (2, "GPL"), (3, "the mit license"), (4, "under the MIT license"), (5, "nothing")])).collect()}
    assert got[1][0] == "gpl-3-or-later" and got[4] == ("mit", 1.0) and got[3] == ("mit", 0.8) and got[5] == ("", 0.0)


def test_hundreds_of_rules():
    table = L.rules()
    assert len(table) > 300 and len(set(table)) == len(table)
    assert all(re.compile(L.spaced(e)) for _, _, e in table)


def test_empty_table(docs):
    assert L.scan(docs([])).count() == 0


def example(parts, rnd):
    """Some text that an expression finds."""
    out = ""
    for op, value in parts:
        if op is _constants.LITERAL:
            out += chr(value)
        elif op is _constants.IN:
            kind, x = rnd.choice(value)
            out += chr(x if kind is _constants.LITERAL else rnd.randint(*x))
        elif op is _constants.BRANCH:
            out += example(rnd.choice(value[1]), rnd)
        elif op is _constants.SUBPATTERN:
            out += example(value[3], rnd)
        else:
            assert op is _constants.MAX_REPEAT
            out += "".join(example(value[2], rnd) for _ in range(rnd.randint(value[0], min(value[1], 3))))
    return out


SPELLINGS = {
    "GPLv3": "gpl-3", "GPL v2": "gpl-2", "GPLv2+": "gpl-2", "gpl 3 or later": "gpl-3-or-later", "LGPLv2.1": "lgpl-2-1", "LGPL-3.0-or-later": "lgpl-3-or-later", "AGPLv3": "agpl-3", "AGPL version 3.0 only": "agpl-3-only",
    "GNU GPL, version 2": "gpl-2", "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "gpl-2-or-later",
    "GNU Lesser General Public License v. 2.1": "lgpl-2-1", "Library General Public Licence 2": "lgpl-2", "Affero General Public License version 3": "agpl-3", "GNU Free Documentation License, Version 1.3 or any later version": "gfdl-1-3",
    "Apache-2.0": "apache-2", "Apache 2.0": "apache-2", "Apache 2 license": "apache-2", "Apache License 2.0": "apache-2", "Apache Software License, version 1.1": "apache-1-1", "ASL 2.0": "apache-2", "Apache License": "apache",
    "MIT license": "mit", "MIT-licensed": "mit", "The Expat license": "mit", "MIT/X11 license": "mit", "MIT-0": "mit-0", "ISC Licence": "isc", "3-clause BSD": "bsd-3-clause", "BSD-2-Clause": "bsd-2-clause", "new BSD license": "bsd-3-clause", "BSD-style licence": "bsd",
    "0BSD": "0bsd", "zlib/libpng license": "zlib", "Boost Software License 1.0": "bsl-1-0", "the Unlicense": "unlicense", "WTFPL": "wtfpl", "beer-ware": "beerware", "same terms as Perl itself": "perl", "PSF license": "python-2", "Zope Public License (ZPL) 2.1": "zpl,zpl-2-1",
    "MPL 2.0": "mpl-2", "Mozilla Public License Version 1.1": "mpl-1-1", "EPL-2.0": "epl-2", "EUPL v1.2": "eupl-1-2", "CDDL 1.0": "cddl-1-0", "Common Public License 1.0": "cpl-1-0", "CeCILL-B": "cecill-b", "SIL Open Font License 1.1": "ofl-1-1", "Artistic License 2.0": "artistic-2",
    "Business Source License 1.1": "busl-1-1", "Elastic License 2.0": "elastic-2", "Server Side Public License": "sspl-1", "Commons Clause": "commons-clause", "Open Database License": "odbl-1-0", "Open Government Licence v3.0": "ogl-3", "BigScience OpenRAIL-M": "openrail", "Llama 3.1 Community License": "llama",
    "CC0 1.0 Universal": "cc0", "CC BY 4.0": "cc-by-4", "CC-BY-SA 3.0": "cc-by-sa-3", "Creative Commons Attribution-ShareAlike 2.5 Generic": "cc-by-sa-2-5", "creativecommons.org/licenses/by-nd/4.0": "cc-by-nd", "cc by nc nd": "cc-by-nc,cc-by-nc-nd", "Creative Commons Attribution-NoDerivs": "cc-by-nd",
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2-or-later", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "All rights reserved.": "all-rights-reserved", "proprietary license": "proprietary", "Confidential and proprietary": "proprietary",
    "It was placed in the public domain.": "public-domain", "dedicated to the public domain": "public-domain", "for non-commercial use only": "non-commercial", "noncommercial purposes": "non-commercial", "for research use only": "research-only", "may not be used to train AI models": "no-ai-training",
    "mitigate apaches": "", "a general public holiday": "", "perl script": "", "question of public interest": "",
}


def test_spellings_that_real_texts_have(docs):
    got = {r.doc_id: r.labels for r in L.scan(docs(list(enumerate(SPELLINGS)))).collect()}
    assert {t: got[i] for i, t in enumerate(SPELLINGS) if got[i] != SPELLINGS[t]} == {}


def test_every_rule_finds_what_it_says_and_its_keyword_lets_it_pass(docs):
    """Six texts made from each rule: the scan, gated, agrees with all rules run on all texts."""
    rnd = random.Random(8)
    made = [(rank, example(_parser.parse(e), rnd)) for rank, (_, _, e) in enumerate(L.rules()) for _ in range(6)]
    for rank, text in made:
        label, key, e = L.rules()[rank]
        norm = " " + "  ".join(text.split()) + " "
        assert re.fullmatch(L.spaced(e), norm), (label, text)
        assert " " + key in norm, (label, key, text)
    got = {r.doc_id: (r.labels, r.n_detections) for r in L.scan(docs([(i, t) for i, (_, t) in enumerate(made)])).collect()}
    want = {i: brute(t)[5:] for i, (_, t) in enumerate(made)}
    assert {i: (made[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert all(n for _, n in want.values())


def resolved(spark, found):
    row = spark.createDataFrame([(found,)], "found array<struct<start:int,stop:int,rank:int,label:string>>")
    out = row.selectExpr("found", f"{L.OUTER} as outer").selectExpr(f"{L.BEST} as best").first().best
    return sorted(tuple(d) for d in out)


def test_chains_resolve_alike_from_both_ends(spark):
    high, mid, low = 0, 1, 2
    chain = lambda *ranks: [(10 * k, 10 * k + 15, r, f"r{r}") for k, r in enumerate(ranks)]
    assert [d[2] for d in resolved(spark, chain(high, mid, low))] == [high, low]
    assert [d[2] for d in resolved(spark, chain(low, mid, high))] == [low, high]
    assert [d[2] for d in resolved(spark, chain(mid, high, low, mid))] == [high, mid]


def test_intervals_against_brute_force(spark):
    rnd = random.Random(3)
    for size, reach in ((5, 30), (40, 100), (700, 3000), (300, 200)):
        for _ in range(4):
            found = [(a, a + rnd.randrange(1, 25), rnd.randrange(9), "x") for a in (rnd.randrange(reach) for _ in range(size))]
            found = list({d[:3]: d for d in found}.values())
            assert resolved(spark, found) == sorted(resolve(found))


def test_very_many_matches_in_one_text(docs):
    import time

    began = time.time()
    r = L.scan(docs([(1, "mit license, " * 60_000)])).first()
    assert r.n_detections == 60_000 and r.labels == "mit"
    assert time.time() - began < 60
