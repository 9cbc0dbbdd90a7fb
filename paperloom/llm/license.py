"""License scan by ordered signature rules (operator 2); DataFrame functions only.

A text becomes its words, lower-cased (A-Z only), two blanks between words and one at
either end, so that each word owns its blanks and neighbouring matches share none. Rules
(``RULES``, one a line) are regular expressions over that form, in order of priority, each
with a keyword or key phrase that stands in whatever it finds. One search for any of these
passes most texts by; then a rule's expression runs only where its keyword stands. Every
match is an interval. A match inside a longer one is suppressed, and of equal intervals the
rule of higher priority stays. Of what is left, intervals that overlap in part are resolved
by priority: whoever has the highest priority (the first place, if it is the same rule)
stays and removes those it overlaps, and so on among the rest; so an interval goes only if
one that stays overlaps it.

Base phrases are fixed: all their places are counted and their labels always stay.

Lists are built in blocks of ``BLOCK``, so the cost of a text is about linear in its matches.

Cases: a null or wordless text has n_words 0, no label, null positions and score 0;
repeated rows and null doc_ids have a row each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii

# fixed values: phrases and labels of the contract
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

NOTICE = 40  # characters
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BLOCK = 256  # entries of a list that are appended one by one

#: label ; keyword ; expression over single-blanked words, in order of priority. An optional blank is
#: written ' ?'. Short forms in angle brackets stand in SHORT.
RULES = r"""
# GNU licences
agpl-3-or-later ; affero ; (?:gnu )?affero general public <licence>(?:<version>3(?: 0)?)<later>
agpl-3-only ; affero ; (?:gnu )?affero general public <licence><version>3(?: 0)? only
agpl-3 ; affero ; (?:gnu )?affero general public <licence><version>3(?: 0)?
agpl-1 ; affero ; (?:gnu )?affero general public <licence><version>1(?: 0)?
agpl ; affero ; (?:gnu )?affero general public <licence>
agpl ; affero ; affero gpl
agpl-3-or-later ; agpl ; (?:gnu )?agpl<version>3(?: 0)?<later>
agpl-3-only ; agpl ; (?:gnu )?agpl<version>3(?: 0)? only
agpl-3 ; agpl ; (?:gnu )?agpl<version>3(?: 0)?
agpl-1 ; agpl ; (?:gnu )?agpl<version>1(?: 0)?
agpl ; agpl ; <under>(?:the )?(?:gnu )?agpl
lgpl-3-or-later ; lesser general ; (?:gnu )?lesser general public <licence><version>3(?: 0)?<later>
lgpl-3-only ; lesser general ; (?:gnu )?lesser general public <licence><version>3(?: 0)? only
lgpl-3 ; lesser general ; (?:gnu )?lesser general public <licence><version>3(?: 0)?
lgpl-2-1-or-later ; lesser general ; (?:gnu )?lesser general public <licence><version>2 1<later>
lgpl-2-1-only ; lesser general ; (?:gnu )?lesser general public <licence><version>2 1 only
lgpl-2-1 ; lesser general ; (?:gnu )?lesser general public <licence><version>2 1
lgpl ; lesser general ; (?:gnu )?lesser general public <licence>
lgpl ; lesser gpl ; gnu lesser gpl
lgpl-2-or-later ; library general ; (?:gnu )?library general public <licence><version>2(?: 0)?<later>
lgpl-2-only ; library general ; (?:gnu )?library general public <licence><version>2(?: 0)? only
lgpl-2 ; library general ; (?:gnu )?library general public <licence><version>2(?: 0)?
lgpl ; library general ; (?:gnu )?library general public <licence>
lgpl-3-or-later ; lgpl ; (?:gnu )?lgpl<version>3(?: 0)?<later>
lgpl-3-only ; lgpl ; (?:gnu )?lgpl<version>3(?: 0)? only
lgpl-3 ; lgpl ; (?:gnu )?lgpl<version>3(?: 0)?
lgpl-2-1-or-later ; lgpl ; (?:gnu )?lgpl<version>2 1<later>
lgpl-2-1-only ; lgpl ; (?:gnu )?lgpl<version>2 1 only
lgpl-2-1 ; lgpl ; (?:gnu )?lgpl<version>2 1
lgpl-2-or-later ; lgpl ; (?:gnu )?lgpl<version>2(?: 0)?<later>
lgpl-2 ; lgpl ; (?:gnu )?lgpl<version>2(?: 0)?
lgpl ; lgpl ; <under>(?:the )?(?:gnu )?lgpl
gpl-3-or-later ; general public ; (?:gnu )?general public <licence><version>3(?: 0)?<later>
gpl-3-only ; general public ; (?:gnu )?general public <licence><version>3(?: 0)? only
gpl-3 ; general public ; (?:gnu )?general public <licence><version>3(?: 0)?
gpl-2-or-later ; general public ; (?:gnu )?general public <licence><version>2(?: 0)?<later>
gpl-2-only ; general public ; (?:gnu )?general public <licence><version>2(?: 0)? only
gpl-2 ; general public ; (?:gnu )?general public <licence><version>2(?: 0)?
gpl-1-or-later ; general public ; (?:gnu )?general public <licence><version>1(?: 0)?<later>
gpl-1 ; general public ; (?:gnu )?general public <licence><version>1(?: 0)?
gpl ; gnu general public ; gnu general public <licence>
gpl-2-or-later ; general public ; (?:gnu )?general public <licence> as published by the free software foundation either version 2 of the <licence><later>
gpl-3-or-later ; general public ; (?:gnu )?general public <licence> as published by the free software foundation either version 3 of the <licence><later>
gpl-3-or-later ; gpl ; (?:gnu )?gpl<version>3(?: 0)?<later>
gpl-3-only ; gpl ; (?:gnu )?gpl<version>3(?: 0)? only
gpl-3 ; gpl ; (?:gnu )?gpl<version>3(?: 0)?
gpl-2-or-later ; gpl ; (?:gnu )?gpl<version>2(?: 0)?<later>
gpl-2-only ; gpl ; (?:gnu )?gpl<version>2(?: 0)? only
gpl-2 ; gpl ; (?:gnu )?gpl<version>2(?: 0)?
gpl-1 ; gpl ; (?:gnu )?gpl<version>1(?: 0)?
gpl ; gpl ; <under>(?:the )?(?:gnu )?gpl
gpl ; gpl ; gpl(?: compatible)? <licence>d?
gpl-classpath ; classpath ; gpl<version>2(?: 0)? with (?:the )?classpath exception
gpl-classpath ; classpath ; gnu classpath(?: exception)?
gfdl-1-3 ; free documentation ; (?:gnu )?free documentation <licence><version>1 3<maybe-later>
gfdl-1-2 ; free documentation ; (?:gnu )?free documentation <licence><version>1 2<maybe-later>
gfdl-1-1 ; free documentation ; (?:gnu )?free documentation <licence><version>1 1<maybe-later>
gfdl ; free documentation ; (?:gnu )?free documentation <licence>
gfdl-1-3 ; gfdl ; (?:gnu )?gfdl<version>1 3<maybe-later>
gfdl-1-2 ; gfdl ; (?:gnu )?gfdl<version>1 2<maybe-later>
gfdl ; gfdl ; (?:gnu )?gfdl
# Apache, BSD, MIT and what stands near them
apache-2 ; apache ; apache(?: software)? <licence><version>2(?: 0)?
apache-2 ; apache ; apache<version>2(?: 0)?(?: <licence>d?)?
apache-2 ; apache ; licensed under the apache <licence>
apache-2 ; apache ; www apache org <licence>s <licence> 2 0
apache-1-1 ; apache ; apache(?: software)? <licence><version>1 1
apache-1-1 ; apache ; apache<version>1 1
apache-1 ; apache ; apache(?: software)? <licence><version>1 0
apache ; apache ; apache(?: software)? <licence>d?
apache-2 ; asl ; asl<version>2(?: 0)?
mit ; permission is hereby granted ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit ; above copyright notice ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit ; mit licen ; (?:under|is|the) (?:an |the )?mit <licence>d?
mit ; mit licen ; mit <licence>d?
mit ; mit x11 ; mit x11 <licence>
mit-0 ; mit no ; mit no attribution(?: <licence>)?
mit-0 ; mit 0 ; mit 0(?: <licence>)?
mit ; expat licen ; expat <licence>
mit ; opensource ; opensource org <licence>s mit
x11 ; x11 licen ; x11 <licence>
isc ; permission to use copy ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc ; isc licen ; isc <licence>d?
isc ; internet systems consortium ; internet systems consortium <licence>
bsd ; redistribution and use ; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause ; neither the name ; neither the name of (?:the )?(?:copyright holder|author|[a-z0-9]+) nor the names of its contributors may be used to endorse or promote products
bsd-4-clause ; all advertising materials ; all advertising materials mentioning features or use of this software must display
bsd-4-clause ; bsd ; (?:4|four) clause bsd(?: <licence>)?
bsd-4-clause ; bsd ; bsd (?:4|four) clause(?: <licence>)?
bsd-4-clause ; bsd ; (?:original|old) bsd <licence>
bsd-3-clause ; bsd ; (?:3|three) clause bsd(?: <licence>)?
bsd-3-clause ; bsd ; bsd (?:3|three) clause(?: <licence>)?
bsd-3-clause ; bsd ; (?:new|modified|revised) bsd(?: <licence>)?
bsd-2-clause ; bsd ; (?:2|two) clause bsd(?: <licence>)?
bsd-2-clause ; bsd ; bsd (?:2|two) clause(?: <licence>)?
bsd-2-clause ; bsd ; simplified bsd(?: <licence>)?
bsd-2-clause ; freebsd ; freebsd <licence>
bsd-1-clause ; bsd ; bsd (?:1|one) clause(?: <licence>)?
0bsd ; 0bsd ; 0bsd
0bsd ; zero clause ; zero clause bsd(?: <licence>)?
bsd ; bsd ; bsd(?: style| type)? <licence>d?
zlib ; must not be misrepresented ; the origin of this software must not be misrepresented
zlib ; zlib ; zlib(?: libpng)? <licence>
libpng ; libpng ; libpng <licence>(?:<version>2)?
bsl-1-0 ; permission is hereby granted ; permission is hereby granted free of charge to any person or organization obtaining a copy of the software
bsl-1-0 ; boost software ; boost software <licence><version>1(?: 0)?
bsl-1-0 ; boost software ; boost software <licence>
unlicense ; free and unencumbered ; this is free and unencumbered software released into the public domain
unlicense ; unlicense ; (?:the )?unlicense
wtfpl ; do what the ; do what the (?:fuck|f) you want to(?: public <licence>)?
wtfpl ; wtfpl ; wtfpl(?:<version>2)?
ncsa ; ncsa ; (?:university of illinois )?ncsa open source <licence>
ncsa ; ncsa ; ncsa <licence>
curl ; curl licen ; curl <licence>
openssl ; openssl ; openssl <licence>
openssl ; openssl ; openssl toolkit <licence>
ssleay ; ssleay ; (?:original )?ssleay <licence>
postgresql ; postgresql ; postgresql <licence>
vim ; vim licen ; vim <licence>
tcl ; tcl ; tcl(?: tk)? <licence>
ftl ; freetype ; freetype(?: project)? <licence>
ijg ; jpeg group ; independent jpeg group(?: s)? <licence>
icu ; icu licen ; icu <licence>
unicode ; unicode ; unicode(?: data files and software)? <licence>
hpnd ; historical permission ; historical permission notice and disclaimer
afl-3 ; academic free ; academic free <licence><version>3(?: 0)?
afl-2-1 ; academic free ; academic free <licence><version>2 1
afl-2 ; academic free ; academic free <licence><version>2 0
afl ; academic free ; academic free <licence>
artistic-2 ; artistic licen ; artistic <licence><version>2(?: 0)?
artistic-1 ; artistic licen ; artistic <licence><version>1(?: 0)?
artistic ; artistic licen ; (?:perl )?artistic <licence>
perl ; terms as perl ; same terms as perl(?: itself)?
python-2 ; python software ; python software foundation <licence>(?:<version>2)?
python-2 ; psf ; psf <licence>(?:<version>2)?
python ; python licen ; python <licence>
cnri-python ; cnri ; cnri(?: open source)? <licence>
ruby ; ruby ; ruby(?: s)? <licence>
php-3-01 ; php licen ; php <licence><version>3 01
php-3 ; php licen ; php <licence><version>3(?: 0)?
php ; php licen ; php <licence>
zpl-2-1 ; zope public ; zope public <licence><version>2 1
zpl-2 ; zope public ; zope public <licence><version>2(?: 0)?
zpl ; zope public ; zope public <licence>
zpl-2-1 ; zpl ; zpl<version>2 1
w3c ; w3c ; w3c(?: software)?(?: notice and)? <licence>
beerware ; beer ; beer ?ware(?: <licence>)?
json ; good not evil ; the software shall be used for good not evil
json ; json licen ; the json <licence>
sleepycat ; sleepycat ; sleepycat <licence>
intel ; intel open ; intel open source <licence>
nasa ; nasa open ; nasa open source agreement(?:<version>1 3)?
upl-1-0 ; universal permissive ; universal permissive <licence>(?:<version>1 0)?
mulan-2 ; mulan ; mulan permissive software <licence>(?:<version>2)?
blueoak ; blue oak ; blue oak model <licence>(?: 1 0 0)?
# copyleft of other houses
mpl-2 ; mozilla public ; mozilla public <licence><version>2(?: 0)?
mpl-1-1 ; mozilla public ; mozilla public <licence><version>1 1
mpl-1 ; mozilla public ; mozilla public <licence><version>1 0
mpl ; mozilla public ; mozilla public <licence>
mpl-2 ; mpl ; mpl<version>2(?: 0)?
mpl-1-1 ; mpl ; mpl<version>1 1
mpl-1 ; mpl ; mpl<version>1 0
mpl ; mpl ; <under>(?:the )?mpl
epl-2 ; eclipse ; eclipse public <licence><version>2(?: 0)?
epl-1 ; eclipse ; eclipse public <licence><version>1(?: 0)?
epl ; eclipse ; eclipse public <licence>
edl-1 ; eclipse ; eclipse distribution <licence>(?:<version>1(?: 0)?)?
epl-2 ; epl ; epl<version>2(?: 0)?
epl-1 ; epl ; epl<version>1(?: 0)?
eupl-1-2 ; european union public ; european union public <licence><version>1 2
eupl-1-1 ; european union public ; european union public <licence><version>1 1
eupl ; european union public ; european union public <licence>
eupl-1-2 ; eupl ; eupl<version>1 2
eupl-1-1 ; eupl ; eupl<version>1 1
eupl ; eupl ; <under>(?:the )?eupl
cddl-1-1 ; common development ; common development and distribution <licence><version>1 1
cddl-1-0 ; common development ; common development and distribution <licence><version>1 0
cddl ; common development ; common development and distribution <licence>
cddl-1-1 ; cddl ; cddl<version>1 1
cddl-1-0 ; cddl ; cddl<version>1 0
cddl ; cddl ; <under>(?:the )?cddl
cpl-1-0 ; common public ; common public <licence>(?:<version>1 0)?
cpal-1-0 ; common public attribution ; common public attribution <licence>(?:<version>1 0)?
ipl-1-0 ; ibm public ; ibm public <licence>(?:<version>1 0)?
osl-3 ; open software ; open software <licence><version>3(?: 0)?
osl-2-1 ; open software ; open software <licence><version>2 1
osl ; open software ; open software <licence>
ms-pl ; microsoft ; microsoft public <licence>
ms-rl ; microsoft ; microsoft reciprocal <licence>
ms-pl ; ms pl ; ms pl
ms-rl ; ms rl ; ms rl
apsl-2 ; apple public ; apple public source <licence><version>2(?: 0)?
apsl ; apple public ; apple public source <licence>
qpl-1-0 ; q public ; q public <licence>(?:<version>1 0)?
sissl ; sun industry ; sun industry standards source <licence>
spl ; sun public ; sun public <licence>(?:<version>1 0)?
npl ; netscape public ; netscape public <licence>(?:<version>1 [01])?
cecill-2-1 ; cecill ; cecill(?: free software <licence>(?: agreement)?)?<version>2 1
cecill-b ; cecill ; cecill b
cecill-c ; cecill ; cecill c
cecill ; cecill ; cecill
ecl-2 ; educational community ; educational community <licence><version>2(?: 0)?
ecl ; educational community ; educational community <licence>
lppl-1-3 ; latex project ; latex project public <licence><version>1 3[ac]?
lppl ; latex project ; latex project public <licence>
lppl-1-3 ; lppl ; lppl<version>1 3[ac]?
ofl-1-1 ; font licen ; (?:sil )?open font <licence><version>1 1
ofl ; font licen ; (?:sil )?open font <licence>
ofl-1-1 ; ofl ; ofl<version>1 1
rpl-1-5 ; reciprocal public ; reciprocal public <licence>(?:<version>1 5)?
simpl-2 ; simple public ; simple public <licence>(?:<version>2 0)?
# source available, data, documents, models
busl-1-1 ; business source ; business source <licence>(?:<version>1 1)?
busl-1-1 ; busl ; busl<version>1 1
elastic-2 ; elastic licen ; elastic <licence><version>2(?: 0)?
elastic ; elastic licen ; elastic <licence>
sspl-1 ; server side ; server side public <licence>(?:<version>1(?: 0)?)?
sspl-1 ; sspl ; sspl(?:<version>1(?: 0)?)?
commons-clause ; commons clause ; commons clause(?: <licence>)?(?: condition)?
polyform ; polyform ; polyform (?:noncommercial|small business|shield|strict|perimeter) <licence>(?: 1 0 0)?
odbl-1-0 ; database licen ; open(?: data commons)? database <licence>(?:<version>1 0)?
odbl-1-0 ; odbl ; odbl(?:<version>1 0)?
odc-by ; open data commons ; open data commons attribution <licence>
pddl ; domain dedication ; public domain dedication and <licence>
cdla-permissive ; community data ; community data <licence> agreement permissive(?:<version>[12] 0)?
cdla-sharing ; community data ; community data <licence> agreement sharing(?:<version>1 0)?
ogl-3 ; open government ; open government <licence>(?:<version>3(?: 0)?)?
dl-de-by ; datenlizenz ; datenlizenz deutschland namensnennung(?:<version>2 0)?
openrail ; openrail ; (?:bigscience |creativeml )?openrail(?: m)?(?: <licence>)?
openrail ; rail ; (?:bigscience )?rail <licence>
llama ; llama ; llama(?: [234])?(?: [123])? community <licence>(?: agreement)?
# Creative Commons
cc0 ; cc0 ; cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0 ; commons zero ; creative commons zero(?: 1 0)?(?: universal)?
cc-by-nc-nd-4 ; creative commons ; creative commons attribution non ?commercial no ?deriv(?:ative)?s? (?:<licence> )?4 0(?: international)?
cc-by-nc-nd-3 ; creative commons ; creative commons attribution non ?commercial no ?deriv(?:ative)?s? (?:<licence> )?3 0(?: unported)?
cc-by-nc-nd ; creative commons ; creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: <licence>)?
cc-by-nc-nd-4 ; cc by ; cc by nc nd<version>4(?: 0)?
cc-by-nc-nd-3 ; cc by ; cc by nc nd<version>3(?: 0)?
cc-by-nc-nd ; cc by ; cc by nc nd
cc-by-nc-sa-4 ; creative commons ; creative commons attribution non ?commercial share ?alike (?:<licence> )?4 0(?: international)?
cc-by-nc-sa-3 ; creative commons ; creative commons attribution non ?commercial share ?alike (?:<licence> )?3 0(?: unported)?
cc-by-nc-sa ; creative commons ; creative commons attribution non ?commercial share ?alike(?: <licence>)?
cc-by-nc-sa-4 ; cc by ; cc by nc sa<version>4(?: 0)?
cc-by-nc-sa-3 ; cc by ; cc by nc sa<version>3(?: 0)?
cc-by-nc-sa ; cc by ; cc by nc sa
cc-by-nd-4 ; creative commons ; creative commons attribution no ?deriv(?:ative)?s? (?:<licence> )?4 0(?: international)?
cc-by-nd ; creative commons ; creative commons attribution no ?deriv(?:ative)?s?(?: <licence>)?
cc-by-nd-4 ; cc by ; cc by nd<version>4(?: 0)?
cc-by-nd ; cc by ; cc by nd
cc-by-sa-4 ; creative commons ; creative commons attribution share ?alike (?:<licence> )?4 0(?: international)?
cc-by-sa-3 ; creative commons ; creative commons attribution share ?alike (?:<licence> )?3 0(?: unported)?
cc-by-sa-2-5 ; creative commons ; creative commons attribution share ?alike (?:<licence> )?2 5(?: generic)?
cc-by-sa ; creative commons ; creative commons attribution share ?alike(?: <licence>)?
cc-by-sa-4 ; cc by ; cc by sa<version>4(?: 0)?
cc-by-sa-3 ; cc by ; cc by sa<version>3(?: 0)?
cc-by-sa-2-5 ; cc by ; cc by sa<version>2 5
cc-by-sa ; cc by ; cc by sa
cc-by-nc-4 ; creative commons ; creative commons attribution non ?commercial (?:<licence> )?4 0(?: international)?
cc-by-nc-3 ; creative commons ; creative commons attribution non ?commercial (?:<licence> )?3 0(?: unported)?
cc-by-nc ; creative commons ; creative commons attribution non ?commercial(?: <licence>)?
cc-by-nc-4 ; cc by ; cc by nc<version>4(?: 0)?
cc-by-nc-3 ; cc by ; cc by nc<version>3(?: 0)?
cc-by-nc ; cc by ; cc by nc
cc-by-4 ; creative commons ; creative commons attribution (?:<licence> )?4 0(?: international)?
cc-by-3 ; creative commons ; creative commons attribution (?:<licence> )?3 0(?: unported)?
cc-by-2-5 ; creative commons ; creative commons attribution (?:<licence> )?2 5(?: generic)?
cc-by ; creative commons ; creative commons attribution(?: <licence>)?
cc-by-4 ; cc by ; cc by<version>4(?: 0)?
cc-by-3 ; cc by ; cc by<version>3(?: 0)?
cc-by-2-5 ; cc by ; cc by<version>2 5
cc-by ; cc by ; cc by
cc-by-nc-nd ; creativecommons ; creativecommons org <licence>s by nc nd(?: [1-4])?(?: [05])?
cc-by-nc-sa ; creativecommons ; creativecommons org <licence>s by nc sa(?: [1-4])?(?: [05])?
cc-by-nd ; creativecommons ; creativecommons org <licence>s by nd(?: [1-4])?(?: [05])?
cc-by-sa ; creativecommons ; creativecommons org <licence>s by sa(?: [1-4])?(?: [05])?
cc-by-nc ; creativecommons ; creativecommons org <licence>s by nc(?: [1-4])?(?: [05])?
cc-by ; creativecommons ; creativecommons org <licence>s by(?: [1-4])?(?: [05])?
cc0 ; creativecommons ; creativecommons org publicdomain zero(?: 1 0)?
cc ; creative commons ; creative commons <licence>
public-domain ; creativecommons ; creativecommons org publicdomain mark(?: 1 0)?
# tags that tools write
agpl-3 ; spdx ; <tag>agpl 3 0(?: only| or later)?
lgpl-3 ; spdx ; <tag>lgpl 3 0(?: only| or later)?
lgpl-2-1 ; spdx ; <tag>lgpl 2 1(?: only| or later)?
gpl-3-or-later ; spdx ; <tag>gpl 3 0 or later
gpl-3 ; spdx ; <tag>gpl 3 0(?: only)?
gpl-2-or-later ; spdx ; <tag>gpl 2 0 or later
gpl-2 ; spdx ; <tag>gpl 2 0(?: only)?
apache-2 ; spdx ; <tag>apache 2 0
mit ; spdx ; <tag>mit
isc ; spdx ; <tag>isc
bsd-2-clause ; spdx ; <tag>bsd 2 clause
bsd-3-clause ; spdx ; <tag>bsd 3 clause
0bsd ; spdx ; <tag>0bsd
zlib ; spdx ; <tag>zlib
mpl-2 ; spdx ; <tag>mpl 2 0
epl-2 ; spdx ; <tag>epl 2 0
bsl-1-0 ; spdx ; <tag>bsl 1 0
cc0 ; spdx ; <tag>cc0 1 0
unlicense ; spdx ; <tag>unlicense
# reserved, given up, limited
all-rights-reserved ; all rights ; all rights (?:are )?reserved
proprietary ; proprietary ; proprietary(?: and confidential| <licence>d?| software)
proprietary ; confidential and proprietary ; confidential and proprietary
proprietary ; eula ; (?:end user <licence> agreement )?eula
proprietary ; end user licen ; end user <licence> agreement
public-domain ; placed in ; (?:is |been )?placed (?:in|into) the public domain
public-domain ; dedicated to ; (?:is |been )?dedicated to the public domain
public-domain ; released ; (?:is |been )?released (?:in|into|to) the public domain
non-commercial ; non commercial ; (?:for )?non commercial (?:use|purposes)(?: only)?
non-commercial ; noncommercial ; (?:for )?noncommercial (?:use|purposes)(?: only)?
research-only ; research use only ; (?:for )?research use only
research-only ; research purposes only ; (?:for )?research purposes only
no-ai-training ; may not be used ; may not be used (?:for|to) (?:train|training)(?: of)?(?: any)? (?:ai|machine learning|language) models?
"""
SHORT = {
    "licence": "licen[cs]e",
    "version": "(?: ?version| ?ver| ?v)? ?v?",  # GPL 3, GPLv3, GPL v3, GPL v 3, GPL version 3
    "later": " (?:or|and) (?:at your option )?(?:any )?(?:later|newer)(?: version)?",
    "maybe-later": "(?: or (?:any )?later(?: version)?)?",
    "under": "(?:under|licen[cs]ed under|terms of|released under|covered by) ",
    "tag": "spdx licen[cs]e identifier ",
}


def rules() -> list[tuple[str, str, str]]:
    """(label, keyword in the normal form, expression over single-blanked words), in order of priority."""
    out = []
    for line in RULES.strip().splitlines():
        if not line.startswith("#"):
            label, keyword, expression = line.split(" ; ")
            out.append((label, keyword.replace(" ", "  "), re.sub("<([a-z-]+)>", lambda m: SHORT[m[1]], expression)))
    return out


def normal(text: Column) -> Column:
    """' word  word ' with two blanks between words; one blank for no words."""
    words = F.trim(F.regexp_replace(fold_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))


def spaced(expression: str) -> str:
    """An expression over single-blanked words, for the normal form: a blank is two, optional
    blanks (as in 'share ?alike') too, and whole words only."""
    wide = re.sub(r" (\?)?", lambda m: "(?:  )?" if m[1] else "  ", expression)
    return f" (?:{wide}) "


def blanks(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))


def gate(table: list[tuple[str, str, str]]) -> str:
    """An expression that finds any keyword or base phrase; every one opens a word, so only what follows a blank counts."""
    keywords = sorted({k for _, k, _ in table} | {p.replace(" ", "  ") for p, _ in BASE})
    by_letter: dict[str, list[str]] = {}
    for k in keywords:
        if not any(o != k and k.startswith(o) for o in keywords):
            by_letter.setdefault(k[0], []).append(k[1:])
    return f" (?:{'|'.join(c + '(?:' + '|'.join(rest) + ')' for c, rest in by_letter.items())})"


# --- intervals, as SQL over arrays of (start, stop, rank, label)

_NONE = "cast(array() as array<struct<start:int,stop:int,rank:int,label:string>>)"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _blocks(array: str) -> str:
    return f"transform(sequence(0, cast((size({array}) - 1) div {BLOCK} as int)), k -> slice({array}, k * {BLOCK} + 1, {BLOCK}))"


def _carried(values: str, zero: int, step: str) -> str:
    """For each value what those before it come to."""
    return f"aggregate({values}, named_struct('at', {zero}, 'out', cast(array() as array<int>)), (acc, x) -> named_struct('at', {step}, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"


# a rule's matches are marked in the text; a match starts where the unmarked lengths of all parts before it end
_PARTS = "split(regexp_replace(norm, r.expr, '\\u0001$0\\u0002'), '\\u0001')"
_LENGTH = "(length(p) - if(contains(p, '\\u0002'), 1, 0))"
_MATCH = "named_struct('start', acc.at, 'stop', acc.at + length(substring_index(p, '\\u0002', 1)), 'rank', r.rank, 'label', r.label)"
_IN_BLOCK = f"aggregate(b, named_struct('at', o, 'out', {_NONE}), (acc, p) -> named_struct('at', acc.at + {_LENGTH}, 'out', if(contains(p, '\\u0002'), array_append(acc.out, {_MATCH}), acc.out)), acc -> acc.out)"
_OFFSETS = _carried(f"transform(blocks, b -> aggregate(b, 0, (s, p) -> s + {_LENGTH}))", 0, "acc.at + x")
_OF_RULE = _let(_PARTS, "parts", _let(_blocks("parts"), "blocks", f"flatten(zip_with(blocks, {_OFFSETS}, (b, o) -> {_IN_BLOCK}))"))
FOUND = f"flatten(transform(rules, r -> {_OF_RULE}))"

# longest first at a start, then priority: whatever ends no later than an earlier one is inside it
_ORDERED = "array_sort(found, (a, b) -> case when a.start <> b.start then a.start - b.start when a.stop <> b.stop then b.stop - a.stop else a.rank - b.rank end)"
_REACH = _carried("transform(blocks, b -> array_max(transform(b, d -> d.stop)))", -1, "greatest(acc.at, x)")
_NOT_INSIDE = f"aggregate(b, named_struct('at', o, 'out', {_NONE}), (acc, d) -> if(d.stop <= acc.at, acc, named_struct('at', d.stop, 'out', array_append(acc.out, d))), acc -> acc.out)"
OUTER = _let(_ORDERED, "sorted", _let(_blocks("sorted"), "blocks", f"flatten(zip_with(blocks, {_REACH}, (b, o) -> {_NOT_INSIDE}))"))

# stretches of intervals each of which overlaps the next; in one, by priority
_OPENS = "filter(sequence(0, size(outer) - 1), k -> k = 0 or outer[k].start >= get(outer, k - 1).stop)"
_BY_RANK = "array_sort(g, (a, b) -> case when a.rank <> b.rank then a.rank - b.rank else a.start - b.start end)"
_RESOLVED = f"if(size(g) = 1, g, aggregate({_BY_RANK}, {_NONE}, (kept, d) -> if(exists(kept, k -> k.start < d.stop and d.start < k.stop), kept, array_append(kept, d))))"
_STRETCH = "slice(outer, s + 1, coalesce(get(opens, i + 1), size(outer)) - s)"
BEST = _let(_OPENS, "opens", f"flatten(transform(opens, (s, i) -> {_let(_STRETCH, 'g', _RESOLVED)}))")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the number
    of kept detections for every row of docs(doc_id, text)."""
    table = rules()
    rows = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    rows = rows.withColumn("n_words", F.floor(blanks(F.col("norm")) / 2).cast("long")).withColumn("hit", F.rlike("norm", F.lit(gate(table))))
    norm = F.col("norm")

    # base phrases: all places, by what stands before the first and after the last
    wide = [(f" {p.replace(' ', '  ')} ", label) for p, label in BASE]
    count = lambda p: (F.length(norm) - F.length(F.replace(norm, F.lit(p), F.lit("")))) / len(p)
    counts = [F.when(F.col("hit"), F.floor(count(p))).otherwise(0).cast("long") for p, _ in wide]
    firsts = [F.when(n > 0, F.floor(blanks(F.substring_index(norm, p, 1)) / 2)) for n, (p, _) in zip(counts, wide, strict=True)]
    lasts = [F.when(n > 0, F.col("n_words") - F.floor(blanks(F.substring_index(norm, p, -1)) / 2) - len(p.split())) for n, (p, _) in zip(counts, wide, strict=True)]
    names = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, (_, label) in zip(counts, wide, strict=True)]))
    rows = rows.withColumns({"n_base": sum(counts[1:], counts[0]), "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"), "base": F.array_sort(names)})

    # rules whose keyword stands in the text, each with all its intervals
    grouped: dict[str, list[Column]] = {}
    for k, (label, key, e) in enumerate(table):
        grouped.setdefault(key, []).append(F.struct(F.lit(k).alias("rank"), F.lit(label).alias("label"), F.lit(spaced(e)).alias("expr")))
    literal = F.array(*[F.struct(F.lit(key).alias("key"), F.array(*some).alias("some")) for key, some in grouped.items()])
    rows = rows.withColumn("rules", F.when(F.col("hit"), F.flatten(F.transform(F.filter(literal, lambda g: F.contains(norm, g["key"])), lambda g: g["some"]))))
    rows = rows.withColumn("found", F.when(F.size("rules") > 0, F.expr(FOUND)))
    rows = rows.withColumn("outer", F.when(F.size("found") > 0, F.expr(OUTER)))
    rows = rows.withColumn("best", F.when(F.size("outer") > 0, F.expr(BEST)))
    mine = F.coalesce(F.transform("best", lambda d: d["label"]), F.array().cast("array<string>"))
    labels = F.array_sort(F.array_distinct(F.concat("base", mine)))
    # a base phrase or a long notice is certain, a short name alone is not
    longest = F.array_max(F.transform("best", lambda d: d["stop"] - d["start"]))
    score = F.when((F.size("base") > 0) | (longest >= NOTICE), 1.0).when(F.size(mine) > 0, 0.8).otherwise(0.0)
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.coalesce(F.size("best"), F.lit(0)).alias("n_detections"))
