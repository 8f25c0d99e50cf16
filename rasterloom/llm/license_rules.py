"""Ordered signature rules for licence statements: label, keyword, priority, pattern.

Patterns are matched against lower-cased words with single spaces between, so "version 2.0" reads
"version 2 0". A rule is tried only on texts that hold its keyword. Of two rules with the same
words and priority the earlier one counts.
"""

from __future__ import annotations

import re

#: Priorities: identifiers, full names with a version, notices, addresses, names without a version, hints.
TAG, EXACT, NOTICE, LINK, NAME, HINT = 100, 90, 80, 70, 60, 30

V1, V11, V12, V13, V2, V21, V3, V31, V4 = (rf"(?:version |v ?|ver )?{x}" for x in (r"1(?: 0)?", "1 1", "1 2", "1 3", r"2(?: 0)?", "2 1", r"3(?: 0)?", "3 1", r"4(?: 0)?"))
LATER = r"(?: (?:only )?(?:or |and )?(?:\(?at your option\)? )?(?:any )?(?:later|newer|above)(?: version)?)"

#: SPDX identifiers that a tag may name, as words.
TAGGED = """0bsd|aal|afl 1 1|afl 1 2|afl 2 0|afl 2 1|afl 3 0|agpl 1 0 only|agpl 1 0 or later|agpl 3 0 only|agpl 3 0 or later|agpl 3 0|apache 1 0|apache 1 1|apache 2 0|apsl 1 0|apsl 2 0|
artistic 1 0|artistic 1 0 perl|artistic 2 0|beerware|blessing|blueoak 1 0 0|bsd 1 clause|bsd 2 clause|bsd 2 clause patent|bsd 3 clause|bsd 3 clause clear|bsd 4 clause|bsd source code|bsl 1 0|busl 1 1|bzip2 1 0 6|
cal 1 0|cc by 1 0|cc by 2 0|cc by 2 5|cc by 3 0|cc by 4 0|cc by nc 3 0|cc by nc 4 0|cc by nc nd 4 0|cc by nc sa 3 0|cc by nc sa 4 0|cc by nd 4 0|cc by sa 2 0|cc by sa 3 0|cc by sa 4 0|cc0 1 0|cddl 1 0|cddl 1 1|
cecill 2 0|cecill 2 1|cecill b|cecill c|cern ohl p 2 0|cern ohl s 2 0|cern ohl w 2 0|cpal 1 0|cpl 1 0|curl|ecl 1 0|ecl 2 0|efl 2 0|elastic 2 0|epl 1 0|epl 2 0|eupl 1 0|eupl 1 1|eupl 1 2|fair|ftl|
gfdl 1 1 only|gfdl 1 1 or later|gfdl 1 2 only|gfdl 1 2 or later|gfdl 1 3 only|gfdl 1 3 or later|gpl 1 0 only|gpl 1 0 or later|gpl 2 0|gpl 2 0 only|gpl 2 0 or later|gpl 3 0|gpl 3 0 only|gpl 3 0 or later|hpnd|icu|ijg|intel|ipl 1 0|isc|json|
lgpl 2 0 only|lgpl 2 0 or later|lgpl 2 1|lgpl 2 1 only|lgpl 2 1 or later|lgpl 3 0|lgpl 3 0 only|lgpl 3 0 or later|libpng|libpng 2 0|lppl 1 3c|miros|mit|mit 0|mit cmu|mpl 1 0|mpl 1 1|mpl 2 0|ms pl|ms rl|mulanpsl 2 0|
ncsa|nist pd|ntp|odbl 1 0|odc by 1 0|ofl 1 0|ofl 1 1|oldap 2 8|openssl|osl 1 0|osl 2 0|osl 2 1|osl 3 0|pddl 1 0|php 3 0|php 3 01|postgresql|psf 2 0|python 2 0|qpl 1 0|ruby|sgi b 2 0|sissl|sleepycat|sspl 1 0|tcl|unicode dfs 2016|
unlicense|upl 1 0|vim|w3c|wtfpl|x11|xnet|zend 2 0|zlib|zpl 2 0|zpl 2 1""".replace("\n", "").split("|")  # fmt: skip

#: label ; keyword ; priority ; pattern
WRITTEN = rf"""
mit ; mit ; {EXACT} ; (?:the )?mit licen[sc]e
mit ; mit ; {NOTICE} ; (?:released|distributed|licen[sc]ed|available|covered|provided|published) under (?:the )?(?:terms of )?(?:the )?mit(?: x11| expat)?(?: licen[sc]e)?
mit ; opensource org ; {LINK} ; opensource org licen[sc]es mit(?: licen[sc]e)?
mit ; permission is hereby granted ; {NOTICE} ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit ; without restriction ; {HINT} ; to deal in the software without restriction including without limitation the rights
mit ; above copyright notice ; {HINT} ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 ; no attribution ; {EXACT} ; mit no attribution(?: licen[sc]e)?
mit-expat ; expat ; {EXACT} ; expat(?: mit)? licen[sc]e
x11 ; x11 ; {EXACT} ; (?:x11|x consortium) licen[sc]e
x11 ; x consortium ; {NOTICE} ; except as contained in this notice the name of the x consortium shall not be used
apache ; apache ; {NAME} ; (?:the )?apache(?: software)?(?: foundation)? licen[sc]e
apache-2.0 ; apache ; {EXACT} ; (?:the )?apache(?: software)? licen[sc]e {V2}
apache-2.0 ; apache ; {NOTICE} ; (?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[sc]e {V2}
apache-2.0 ; apache ; {EXACT} ; apache {V2}(?: licen[sc]e)?
apache-2.0 ; asl ; {EXACT} ; asl {V2}
apache-2.0 ; apache org ; {LINK} ; apache org licen[sc]es licen[sc]e 2 0(?: txt| html)?
apache-2.0 ; in compliance with the license ; {HINT} ; you may not use this file except in compliance with the licen[sc]e
apache-2.0 ; on an as is basis ; {HINT} ; distributed on an as is basis without warranties or conditions of any kind
apache-1.1 ; apache ; {EXACT} ; (?:the )?apache(?: software)? licen[sc]e {V11}
apache-1.0 ; apache ; {EXACT} ; (?:the )?apache(?: software)? licen[sc]e (?:version )?1 0
gpl ; general public license ; {NAME} ; (?:the )?(?:gnu )?general public licen[sc]e
gpl ; gnu gpl ; {NAME} ; (?:the )?gnu gpl
gpl-1.0 ; general public license ; {EXACT} ; (?:the )?(?:gnu )?general public licen[sc]e {V1}
gpl-2.0 ; general public license ; {EXACT} ; (?:the )?(?:gnu )?general public licen[sc]e {V2}
gpl-2.0-or-later ; general public license ; {EXACT} ; (?:the )?(?:gnu )?general public licen[sc]e {V2}{LATER}
gpl-3.0 ; general public license ; {EXACT} ; (?:the )?(?:gnu )?general public licen[sc]e {V3}
gpl-3.0 ; general public license ; {NOTICE} ; this (?:work|program|software|library|file) is (?:free software )?licen[sc]ed under (?:the )?(?:terms of )?(?:the )?gnu general public licen[sc]e {V3}
gpl-3.0-or-later ; general public license ; {EXACT} ; (?:the )?(?:gnu )?general public licen[sc]e {V3}{LATER}
gpl-2.0 ; gpl ; {EXACT} ; (?:gnu )?gpl ?v? ?2(?: 0)?(?: only)?
gpl-2.0-or-later ; gpl ; {EXACT} ; (?:gnu )?gpl ?v? ?2(?: 0)?{LATER}
gpl-3.0 ; gpl ; {EXACT} ; (?:gnu )?gpl ?v? ?3(?: 0)?(?: only)?
gpl-3.0-or-later ; gpl ; {EXACT} ; (?:gnu )?gpl ?v? ?3(?: 0)?{LATER}
gpl-2.0 ; gplv2 ; {EXACT} ; gplv2
gpl-3.0 ; gplv3 ; {EXACT} ; gplv3
gpl ; gnu org ; {LINK} ; gnu org (?:copyleft|licen[sc]es) gpl(?: html| txt)?
gpl ; free software foundation ; {NOTICE} ; redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl ; free software foundation ; {HINT} ; as published by the free software foundation
gpl-classpath ; classpath ; {EXACT} ; (?:gpl )?with (?:the )?classpath exception
lgpl ; lesser general public license ; {NAME} ; (?:the )?(?:gnu )?lesser general public licen[sc]e
lgpl ; library general public license ; {NAME} ; (?:the )?(?:gnu )?library general public licen[sc]e
lgpl-2.0 ; library general public license ; {EXACT} ; (?:the )?(?:gnu )?library general public licen[sc]e {V2}
lgpl-2.1 ; lesser general public license ; {EXACT} ; (?:the )?(?:gnu )?lesser general public licen[sc]e {V21}
lgpl-2.1-or-later ; lesser general public license ; {EXACT} ; (?:the )?(?:gnu )?lesser general public licen[sc]e {V21}{LATER}
lgpl-3.0 ; lesser general public license ; {EXACT} ; (?:the )?(?:gnu )?lesser general public licen[sc]e {V3}
lgpl-3.0-or-later ; lesser general public license ; {EXACT} ; (?:the )?(?:gnu )?lesser general public licen[sc]e {V3}{LATER}
lgpl ; lgpl ; {NAME} ; (?:gnu )?lgpl
lgpl-2.1 ; lgpl ; {EXACT} ; (?:gnu )?lgpl ?v? ?2 1
lgpl-3.0 ; lgpl ; {EXACT} ; (?:gnu )?lgpl ?v? ?3(?: 0)?
lgpl ; gnu org ; {LINK} ; gnu org (?:copyleft|licen[sc]es) lgpl(?: html| txt)?
agpl ; affero ; {NAME} ; (?:the )?(?:gnu )?affero general public licen[sc]e
agpl-1.0 ; affero ; {EXACT} ; (?:the )?affero general public licen[sc]e {V1}
agpl-3.0 ; affero ; {EXACT} ; (?:the )?(?:gnu )?affero general public licen[sc]e {V3}
agpl-3.0-or-later ; affero ; {EXACT} ; (?:the )?(?:gnu )?affero general public licen[sc]e {V3}{LATER}
agpl ; agpl ; {NAME} ; (?:gnu )?agpl
agpl-3.0 ; agpl ; {EXACT} ; (?:gnu )?agpl ?v? ?3(?: 0)?
gfdl ; free documentation license ; {NAME} ; (?:the )?(?:gnu )?free documentation licen[sc]e
gfdl-1.1 ; free documentation license ; {EXACT} ; (?:the )?(?:gnu )?free documentation licen[sc]e {V11}
gfdl-1.2 ; free documentation license ; {EXACT} ; (?:the )?(?:gnu )?free documentation licen[sc]e {V12}
gfdl-1.3 ; free documentation license ; {EXACT} ; (?:the )?(?:gnu )?free documentation licen[sc]e {V13}
gfdl ; invariant sections ; {NOTICE} ; with no invariant sections no front cover texts and no back cover texts
bsd ; bsd ; {NAME} ; bsd(?: style| like| type)? licen[sc]e
bsd ; bsd ; {NAME} ; berkeley software distribution licen[sc]e
bsd-0-clause ; bsd ; {EXACT} ; (?:0bsd|zero clause bsd|bsd zero clause|0 clause bsd)(?: licen[sc]e)?
bsd-1-clause ; bsd ; {EXACT} ; (?:1|one) clause bsd(?: licen[sc]e)?
bsd-2-clause ; bsd ; {EXACT} ; (?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)(?: licen[sc]e)
bsd-3-clause ; bsd ; {EXACT} ; (?:(?:3|three) clause bsd|bsd (?:3|three) clause|new bsd|modified bsd|revised bsd)(?: licen[sc]e)
bsd-4-clause ; bsd ; {EXACT} ; (?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd|old bsd)(?: licen[sc]e)
bsd ; redistribution and use ; {NOTICE} ; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd ; redistributions of source code ; {HINT} ; redistributions of source code must retain the (?:above )?copyright notice
bsd ; redistributions in binary form ; {HINT} ; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause ; endorse or promote ; {NOTICE} ; neither the names? of (?:[^ ]+ ){{1,12}}nor the names of (?:its|the) contributors may be used to endorse or promote products
bsd-4-clause ; advertising materials ; {NOTICE} ; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause ; opensource org ; {LINK} ; opensource org licen[sc]es bsd 2 clause
bsd-3-clause ; opensource org ; {LINK} ; opensource org licen[sc]es bsd 3 clause
isc ; isc ; {EXACT} ; (?:the )?isc licen[sc]e
isc ; permission to use ; {NOTICE} ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd ; permission to use ; {NOTICE} ; permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
mpl ; mozilla ; {NAME} ; (?:the )?mozilla public licen[sc]e
mpl-1.0 ; mozilla ; {EXACT} ; (?:the )?mozilla public licen[sc]e (?:version |v )?1 0
mpl-1.1 ; mozilla ; {EXACT} ; (?:the )?mozilla public licen[sc]e {V11}
mpl-2.0 ; mozilla ; {EXACT} ; (?:the )?mozilla public licen[sc]e {V2}
mpl-2.0 ; mozilla org ; {LINK} ; mozilla org mpl 2 0
mpl-1.1 ; mozilla org ; {LINK} ; mozilla org mpl mpl 1 1(?: html)?
mpl-2.0 ; mpl ; {EXACT} ; mpl ?v? ?2(?: 0)?
epl ; eclipse ; {NAME} ; (?:the )?eclipse public licen[sc]e
epl-1.0 ; eclipse ; {EXACT} ; (?:the )?eclipse public licen[sc]e {V1}
epl-2.0 ; eclipse ; {EXACT} ; (?:the )?eclipse public licen[sc]e {V2}
edl-1.0 ; eclipse ; {EXACT} ; (?:the )?eclipse distribution licen[sc]e(?: {V1})?
cddl ; common development ; {NAME} ; (?:the )?common development and distribution licen[sc]e
cddl-1.0 ; common development ; {EXACT} ; (?:the )?common development and distribution licen[sc]e(?: cddl)? {V1}
cddl-1.1 ; common development ; {EXACT} ; (?:the )?common development and distribution licen[sc]e(?: cddl)? {V11}
cpl-1.0 ; common public ; {EXACT} ; (?:the )?common public licen[sc]e(?: {V1})?
cpal-1.0 ; common public attribution ; {EXACT} ; (?:the )?common public attribution licen[sc]e(?: {V1})?
cc ; creative commons ; {NAME} ; creative commons(?: licen[sc]e)?
cc-by ; creative commons ; {EXACT} ; creative commons attribution(?: licen[sc]e)?(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: licen[sc]e)?
cc-by-sa ; creative commons ; {EXACT} ; creative commons attribution share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: licen[sc]e)?
cc-by-nc ; creative commons ; {EXACT} ; creative commons attribution non ?commercial(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: licen[sc]e)?
cc-by-nd ; creative commons ; {EXACT} ; creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: licen[sc]e)?
cc-by-nc-sa ; creative commons ; {EXACT} ; creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: licen[sc]e)?
cc-by-nc-nd ; creative commons ; {EXACT} ; creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: licen[sc]e)?
cc-by ; cc by ; {EXACT} ; (?:licen[sc]ed under )?cc by(?: [1-4] [05])
cc-by-sa ; cc by ; {EXACT} ; (?:licen[sc]ed under )?cc by sa(?: [1-4] [05])?
cc-by-nc ; cc by ; {EXACT} ; (?:licen[sc]ed under )?cc by nc(?: [1-4] [05])?
cc-by-nd ; cc by ; {EXACT} ; (?:licen[sc]ed under )?cc by nd(?: [1-4] [05])?
cc-by-nc-sa ; cc by ; {EXACT} ; (?:licen[sc]ed under )?cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd ; cc by ; {EXACT} ; (?:licen[sc]ed under )?cc by nc nd(?: [1-4] [05])?
cc-by ; creativecommons org ; {LINK} ; creativecommons org licen[sc]es by [1-4] [05]
cc-by-sa ; creativecommons org ; {LINK} ; creativecommons org licen[sc]es by sa [1-4] [05]
cc-by-nc ; creativecommons org ; {LINK} ; creativecommons org licen[sc]es by nc [1-4] [05]
cc-by-nc-sa ; creativecommons org ; {LINK} ; creativecommons org licen[sc]es by nc sa [1-4] [05]
cc-by-nc-nd ; creativecommons org ; {LINK} ; creativecommons org licen[sc]es by nc nd [1-4] [05]
cc0-1.0 ; cc0 ; {EXACT} ; cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 ; creativecommons org ; {LINK} ; creativecommons org publicdomain zero 1 0
public-domain ; public domain ; {NAME} ; (?:is |released |placed |dedicated )?(?:in|into|to) the public domain
public-domain ; public domain ; {NOTICE} ; free and unencumbered software released into the public domain
unlicense ; unlicense ; {EXACT} ; (?:the )?unlicense
wtfpl ; wtfpl ; {EXACT} ; wtfpl
wtfpl ; public license ; {EXACT} ; do what the f[a-z]* you want to public licen[sc]e
zlib ; zlib ; {EXACT} ; (?:the )?zlib(?: libpng)? licen[sc]e
zlib ; altered source versions ; {NOTICE} ; altered source versions must be plainly marked as such
libpng ; libpng ; {EXACT} ; (?:the )?(?:lib)?png(?: reference library)? licen[sc]e
bsl-1.0 ; boost ; {EXACT} ; (?:the )?boost software licen[sc]e(?: {V1})?
busl-1.1 ; business source ; {EXACT} ; (?:the )?business source licen[sc]e(?: {V11})?
artistic ; artistic ; {NAME} ; (?:the )?(?:perl )?artistic licen[sc]e
artistic-1.0 ; artistic ; {EXACT} ; (?:the )?artistic licen[sc]e {V1}
artistic-2.0 ; artistic ; {EXACT} ; (?:the )?artistic licen[sc]e {V2}
perl ; same terms as perl ; {NOTICE} ; under the same terms as perl itself
psf-2.0 ; python software foundation ; {EXACT} ; (?:the )?python software foundation licen[sc]e(?: {V2})?
python ; python license ; {NAME} ; (?:the )?python licen[sc]e
ruby ; ruby ; {EXACT} ; (?:the )?ruby(?: s)? licen[sc]e
php ; php ; {EXACT} ; (?:the )?php licen[sc]e(?: (?:version )?3 (?:0|01))?
openssl ; openssl ; {EXACT} ; (?:the )?openssl licen[sc]e
ncsa ; ncsa ; {EXACT} ; (?:university of illinois )?ncsa(?: open source)? licen[sc]e
afl ; academic free ; {EXACT} ; (?:the )?academic free licen[sc]e(?: (?:version |v )?[1-3] [0-2])?
osl ; open software license ; {EXACT} ; (?:the )?open software licen[sc]e(?: (?:version |v )?[1-3] [0-2])?
eupl ; european union ; {EXACT} ; (?:the )?european union public licen[sc]e(?: (?:version |v ?)?1 [0-2])?
eupl ; eupl ; {EXACT} ; eupl(?: (?:version |v ?)?1 [0-2])?
cecill ; cecill ; {EXACT} ; cecill(?: [bc]| 2 [01])?(?: free software)?(?: licen[sc]e)?
ofl-1.1 ; open font ; {EXACT} ; (?:the )?(?:sil )?open font licen[sc]e(?: {V11})?
vim ; vim ; {EXACT} ; (?:the )?vim licen[sc]e
beerware ; beer ; {EXACT} ; (?:the )?beer ?ware licen[sc]e
json ; json ; {EXACT} ; (?:the )?json licen[sc]e
json ; for good not evil ; {NOTICE} ; the software shall be used for good not evil
icu ; icu ; {EXACT} ; (?:the )?icu licen[sc]e
unicode ; unicode ; {EXACT} ; unicode(?: data files and software| inc)? licen[sc]e(?: agreement)?
w3c ; w3c ; {EXACT} ; (?:the )?w3c(?: software)?(?: notice and| document)? licen[sc]e
ijg ; jpeg group ; {NOTICE} ; this software is based in part on the work of the independent jpeg group
curl ; curl ; {EXACT} ; (?:the )?curl licen[sc]e
zend ; zend ; {EXACT} ; (?:the )?zend(?: engine)? licen[sc]e
qpl-1.0 ; public license ; {EXACT} ; (?:the )?q public licen[sc]e(?: {V1})?
sleepycat ; sleepycat ; {EXACT} ; (?:the )?sleepycat licen[sc]e
sspl-1.0 ; server side ; {EXACT} ; (?:the )?server side public licen[sc]e(?: {V1})?
elastic-2.0 ; elastic ; {EXACT} ; (?:the )?elastic licen[sc]e(?: {V2})?
commons-clause ; commons clause ; {EXACT} ; (?:the )?commons clause(?: licen[sc]e)?(?: condition)?
hippocratic ; hippocratic ; {EXACT} ; (?:the )?hippocratic licen[sc]e
odbl-1.0 ; open database ; {EXACT} ; (?:the )?open database licen[sc]e(?: {V1})?
odc-by-1.0 ; open data commons ; {EXACT} ; open data commons attribution licen[sc]e(?: {V1})?
pddl-1.0 ; open data commons ; {EXACT} ; open data commons public domain dedication(?: and licen[sc]e)?
lppl ; latex project ; {EXACT} ; (?:the )?latex project public licen[sc]e(?: (?:version |v )?1 [0-3][abc]?)?
tcl ; tcl ; {EXACT} ; (?:the )?tcl(?: tk)? licen[sc]e
ntp ; ntp ; {EXACT} ; (?:the )?ntp licen[sc]e
ecl-2.0 ; educational community ; {EXACT} ; (?:the )?educational community licen[sc]e(?: {V2})?
efl-2.0 ; eiffel forum ; {EXACT} ; (?:the )?eiffel forum licen[sc]e(?: {V2})?
ms-pl ; microsoft ; {EXACT} ; (?:the )?microsoft public licen[sc]e
ms-rl ; microsoft ; {EXACT} ; (?:the )?microsoft reciprocal licen[sc]e
apsl-2.0 ; apple public ; {EXACT} ; (?:the )?apple public source licen[sc]e(?: {V2})?
ipl-1.0 ; ibm public ; {EXACT} ; (?:the )?ibm public licen[sc]e(?: {V1})?
mulan-psl-2.0 ; mulan ; {EXACT} ; (?:the )?mulan (?:permissive software|psl)(?: licen[sc]e)?(?: {V2})?
blueoak-1.0.0 ; blue oak ; {EXACT} ; (?:the )?blue oak model licen[sc]e(?: 1 0 0)?
upl-1.0 ; universal permissive ; {EXACT} ; (?:the )?universal permissive licen[sc]e(?: {V1})?
postgresql ; postgresql ; {EXACT} ; (?:the )?postgresql licen[sc]e
zpl ; zope ; {EXACT} ; (?:the )?zope public licen[sc]e(?: (?:version |v )?[12] [01])?
oldap ; openldap ; {EXACT} ; (?:the )?openldap public licen[sc]e(?: (?:version |v )?2 [0-8])?
ftl ; freetype ; {EXACT} ; (?:the )?freetype (?:project )?licen[sc]e
sgi-b ; sgi ; {EXACT} ; sgi free software licen[sc]e b(?: (?:version |v )?[12] [01])?
rpl ; reciprocal public ; {EXACT} ; (?:the )?reciprocal public licen[sc]e(?: (?:version |v )?1 [15])?
cal-1.0 ; cryptographic autonomy ; {EXACT} ; (?:the )?cryptographic autonomy licen[sc]e(?: {V1})?
cern-ohl ; cern ; {EXACT} ; cern open hardware licen[sc]e
fair ; fair license ; {EXACT} ; (?:the )?fair licen[sc]e
nasa ; nasa ; {EXACT} ; nasa open source agreement(?: (?:version |v )?1 3)?
fsfap ; in any medium ; {NOTICE} ; copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved
gpl-verbatim ; verbatim copies ; {HINT} ; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl ; gnu org ; {HINT} ; you should have received a copy of the gnu general public licen[sc]e along with this (?:program|file|library|package)
lgpl ; gnu lesser ; {HINT} ; you should have received a copy of the gnu lesser general public licen[sc]e along with this (?:program|file|library|package)
agpl ; gnu affero ; {HINT} ; you should have received a copy of the gnu affero general public licen[sc]e along with this (?:program|file|library|package)
lgpl ; gnu lesser ; {NOTICE} ; redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e
agpl ; gnu affero ; {NOTICE} ; redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
gcc-exception ; runtime library exception ; {EXACT} ; (?:the )?gcc runtime library exception(?: {V31})?
llvm-exception ; llvm ; {EXACT} ; (?:with )?(?:the )?llvm exceptions?
autoconf-exception ; autoconf ; {EXACT} ; (?:with )?(?:the )?autoconf (?:configure script )?exception
bison-exception ; bison ; {NOTICE} ; as a special exception you may create a larger work that contains part or all of the bison parser skeleton
font-exception ; this font ; {NOTICE} ; if you create a document which uses this font and embed this font or unaltered portions of this font into the document
linking-exception ; linking ; {EXACT} ; (?:with )?(?:an? |the )?(?:gpl |openssl |static )?linking exception
libtool-exception ; libtool ; {NOTICE} ; if you distribute this file as part of a program or library that is built using gnu libtool
swift-exception ; runtime library exception ; {EXACT} ; (?:the )?swift runtime library exception
universal-foss-exception ; foss exception ; {EXACT} ; (?:the )?universal foss exception
wxwindows ; wxwindows ; {EXACT} ; (?:the )?wxwindows(?: library)? licen[sc]e(?: {V31})?
mit-modern ; modern variant ; {EXACT} ; (?:the )?mit (?:licen[sc]e )?modern variant
mit-feh ; mit feh ; {EXACT} ; mit feh(?: licen[sc]e)?
mit-enna ; mit enna ; {EXACT} ; (?:mit )?enna licen[sc]e
bsd ; bsd ; {NOTICE} ; (?:released|distributed|licen[sc]ed|available|covered|provided|published) under (?:the )?(?:terms of )?(?:the |a )?(?:new |modified |simplified )?bsd(?: style)?(?: licen[sc]e)?
bsd-3-clause ; berkeley ; {NOTICE} ; neither the name of the university nor the names of its contributors may be used to endorse or promote products
bsd-2-clause-patent ; bsd ; {EXACT} ; bsd (?:2 clause )?plus patents?(?: licen[sc]e)?
bsd-3-clause-clear ; bsd ; {EXACT} ; (?:the )?clear bsd(?: licen[sc]e)?
bsd-3-clause-lbnl ; lawrence berkeley ; {EXACT} ; lawrence berkeley national labs bsd(?: variant)?(?: licen[sc]e)?
bsd-source-code ; bsd ; {EXACT} ; bsd source code attribution
apache-2.0 ; apache ; {NOTICE} ; licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements
apache-2.0 ; limitations under ; {HINT} ; see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e
mpl-2.0 ; mozilla ; {NOTICE} ; this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0
mpl-1.1 ; mozilla ; {NOTICE} ; the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-2.0-no-copyleft ; secondary licenses ; {NOTICE} ; this source code form is incompatible with secondary licen[sc]es
npl-1.0 ; netscape ; {EXACT} ; (?:the )?netscape public licen[sc]e(?: {V1})?
epl-1.0 ; eclipse ; {NOTICE} ; (?:made )?available under the terms of the eclipse public licen[sc]e v ?1 0
epl-2.0 ; eclipse ; {NOTICE} ; (?:made )?available under the terms of the eclipse public licen[sc]e (?:v ?)?2 0
epl ; eclipse org ; {LINK} ; (?:www )?eclipse org legal epl v[12]0(?: html)?
cddl ; common development ; {NOTICE} ; subject to the terms of the common development and distribution licen[sc]e
sun-public-1.0 ; sun public ; {EXACT} ; (?:the )?sun public licen[sc]e(?: {V1})?
sissl-1.1 ; sun industry ; {EXACT} ; (?:the )?sun industry standards source licen[sc]e(?: {V11})?
apl-1.0 ; adaptive public ; {EXACT} ; (?:the )?adaptive public licen[sc]e(?: {V1})?
aal ; attribution assurance ; {EXACT} ; (?:the )?attribution assurance licen[sc]e
cnri-python ; cnri ; {EXACT} ; (?:the )?cnri(?: open source)?(?: python)? licen[sc]e(?: agreement)?
catosl-1.1 ; computer associates ; {EXACT} ; (?:the )?computer associates trusted open source licen[sc]e(?: {V11})?
cua-opl-1.0 ; cua office ; {EXACT} ; (?:the )?cua office public licen[sc]e(?: {V1})?
entessa ; entessa ; {EXACT} ; (?:the )?entessa public licen[sc]e(?: {V1})?
eudatagrid ; datagrid ; {EXACT} ; (?:the )?eu datagrid software licen[sc]e
frameworx-1.0 ; frameworx ; {EXACT} ; (?:the )?frameworx(?: open)? licen[sc]e(?: {V1})?
hpnd ; historical permission ; {EXACT} ; (?:the )?historical permission notice and disclaimer
intel ; intel ; {EXACT} ; (?:the )?intel open source licen[sc]e
jabber ; jabber ; {EXACT} ; (?:the )?jabber open source licen[sc]e
lpl-1.02 ; lucent ; {EXACT} ; (?:the )?lucent public licen[sc]e(?: (?:version |v )?1 0[02]?)?
motosoto ; motosoto ; {EXACT} ; (?:the )?motosoto(?: open source)? licen[sc]e
multics ; multics ; {EXACT} ; (?:the )?multics licen[sc]e
naumen ; naumen ; {EXACT} ; (?:the )?naumen public licen[sc]e
ngpl ; nethack ; {EXACT} ; (?:the )?nethack general public licen[sc]e
nokia ; nokia ; {EXACT} ; (?:the )?nokia open source licen[sc]e
nposl-3.0 ; non profit ; {EXACT} ; (?:the )?non profit open software licen[sc]e(?: {V3})?
oclc-2.0 ; oclc ; {EXACT} ; (?:the )?oclc research public licen[sc]e(?: {V2})?
ogtsl ; open group ; {EXACT} ; (?:the )?open group test suite licen[sc]e
rscpl ; ricoh ; {EXACT} ; (?:the )?ricoh source code public licen[sc]e
simpl-2.0 ; simple public ; {EXACT} ; (?:the )?simple public licen[sc]e(?: {V2})?
watcom-1.0 ; watcom ; {EXACT} ; (?:the )?sybase open watcom public licen[sc]e(?: {V1})?
vsl-1.0 ; vovida ; {EXACT} ; (?:the )?vovida software licen[sc]e(?: {V1})?
xnet ; x net ; {EXACT} ; (?:the )?x net licen[sc]e
liliq ; libre du quebec ; {EXACT} ; licence libre du quebec(?: permissive| reciprocite(?: forte)?)?
free-art ; free art ; {EXACT} ; (?:the )?free art licen[sc]e(?: {V13})?
free-art ; art libre ; {EXACT} ; licence art libre(?: {V13})?
ogl-uk ; open government ; {EXACT} ; (?:the )?open government licen[sc]e(?: {V3}| {V2}| {V1})?
etalab-2.0 ; etalab ; {EXACT} ; etalab open licen[sc]e {V2}
etalab-2.0 ; licence ouverte ; {EXACT} ; licence ouverte (?:etalab )?{V2}(?: etalab)?
dl-de-by-2.0 ; data licence germany ; {EXACT} ; data licence germany attribution(?: {V2})?
cdla-permissive ; community data ; {EXACT} ; (?:the )?community data licen[sc]e agreement permissive(?: {V1}| {V2})?
cdla-sharing ; community data ; {EXACT} ; (?:the )?community data licen[sc]e agreement sharing(?: {V1})?
o-uda ; open use of data ; {EXACT} ; (?:the )?open use of data agreement(?: {V1})?
openrail-m ; rail m ; {EXACT} ; (?:creativeml |bigscience |bigcode )?open ?rail m(?: licen[sc]e)?
rail ; responsible ai ; {EXACT} ; (?:the )?responsible ai licen[sc]e
llama-community ; llama ; {EXACT} ; (?:meta )?llama (?:[2-4] |3 [1-3] )?community licen[sc]e(?: agreement)?
gemma ; gemma ; {EXACT} ; (?:the )?gemma terms of use
polyform-noncommercial ; polyform ; {EXACT} ; (?:the )?polyform non ?commercial licen[sc]e(?: 1 0 0)?
polyform-small-business ; polyform ; {EXACT} ; (?:the )?polyform small business licen[sc]e(?: 1 0 0)?
polyform-shield ; polyform ; {EXACT} ; (?:the )?polyform shield licen[sc]e(?: 1 0 0)?
polyform-strict ; polyform ; {EXACT} ; (?:the )?polyform strict licen[sc]e(?: 1 0 0)?
polyform-perimeter ; polyform ; {EXACT} ; (?:the )?polyform perimeter licen[sc]e(?: 1 0 [01])?
polyform-internal-use ; polyform ; {EXACT} ; (?:the )?polyform internal use licen[sc]e(?: 1 0 0)?
prosperity ; prosperity ; {EXACT} ; (?:the )?prosperity public licen[sc]e(?: {V2}| {V3})?
parity ; parity ; {EXACT} ; (?:the )?parity public licen[sc]e(?: [67] 0(?: 0)?)?
big-time ; big time ; {EXACT} ; (?:the )?big time public licen[sc]e
fsl-1.1 ; functional source ; {EXACT} ; (?:the )?functional source licen[sc]e(?: {V11})?
fcl-1.0 ; fair core ; {EXACT} ; (?:the )?fair core licen[sc]e(?: {V1})?
sustainable-use ; sustainable use ; {EXACT} ; (?:the )?sustainable use licen[sc]e(?: {V1})?
confluent ; confluent ; {EXACT} ; (?:the )?confluent community licen[sc]e(?: agreement)?(?: {V1})?
rsal-2.0 ; source available ; {EXACT} ; (?:the )?redis source available licen[sc]e(?: {V2})?
timescale ; timescale ; {EXACT} ; (?:the )?timescale licen[sc]e
cockroach ; cockroach ; {EXACT} ; (?:the )?cockroach(?:db)? community licen[sc]e
anti-996 ; anti 996 ; {EXACT} ; (?:the )?anti 996 licen[sc]e(?: {V1})?
acsl ; anti capitalist ; {EXACT} ; (?:the )?anti capitalist software licen[sc]e(?: 1 4)?
cnpl ; nonviolent ; {EXACT} ; (?:the )?cooperative nonviolent(?: public)? licen[sc]e
peer-production ; peer production ; {EXACT} ; (?:the )?peer production licen[sc]e
jrl ; java research ; {EXACT} ; (?:the )?java research licen[sc]e
bcl ; binary code ; {EXACT} ; (?:the )?(?:oracle |sun )?binary code licen[sc]e(?: agreement)?
otn ; technology network ; {EXACT} ; (?:the )?oracle technology network licen[sc]e(?: agreement)?
freebsd-doc ; documentation license ; {EXACT} ; (?:the )?freebsd documentation licen[sc]e
ldp ; linux documentation ; {EXACT} ; (?:the )?linux documentation project licen[sc]e
opl ; open publication ; {EXACT} ; (?:the )?open publication licen[sc]e(?: {V1})?
opencontent ; opencontent ; {EXACT} ; (?:the )?open ?content licen[sc]e(?: {V1})?
dsl ; design science ; {EXACT} ; (?:the )?design science licen[sc]e
ogl-1.0 ; open game ; {EXACT} ; (?:the )?open game licen[sc]e(?: {V1})?
orc ; open rpg ; {EXACT} ; (?:the )?open rpg creative licen[sc]e
ubuntu-font ; ubuntu font ; {EXACT} ; (?:the )?ubuntu font licen[sc]e(?: {V1})?
bitstream-vera ; bitstream ; {EXACT} ; (?:the )?bitstream vera(?: fonts?)?(?: copyright| licen[sc]e)
imagemagick ; imagemagick ; {EXACT} ; (?:the )?imagemagick licen[sc]e
gdlib ; gd library ; {EXACT} ; (?:the )?gd(?: graphics)? library licen[sc]e
infozip ; info zip ; {EXACT} ; (?:the )?info zip licen[sc]e
bzip2 ; bzip2 ; {EXACT} ; (?:the )?(?:bzip2 and libbzip2|bzip2) licen[sc]e
libtiff ; libtiff ; {EXACT} ; (?:the )?libtiff licen[sc]e
net-snmp ; net snmp ; {EXACT} ; (?:the )?net snmp licen[sc]e
tcp-wrappers ; tcp wrappers ; {EXACT} ; (?:the )?tcp wrappers licen[sc]e
xfree86-1.1 ; xfree86 ; {EXACT} ; (?:the )?xfree86(?: project)? licen[sc]e(?: {V11})?
crystal-stacker ; crystal stacker ; {EXACT} ; (?:the )?crystal stacker licen[sc]e
glide ; 3dfx ; {EXACT} ; (?:the )?3dfx glide(?: source code)? (?:general )?public licen[sc]e
mulan-publ-2.0 ; mulan ; {EXACT} ; (?:the )?mulan public licen[sc]e(?: {V2})?
zimbra ; zimbra ; {EXACT} ; (?:the )?zimbra public licen[sc]e(?: 1 [34])?
yahoo-1.1 ; yahoo ; {EXACT} ; (?:the )?yahoo public licen[sc]e(?: {V11})?
sugarcrm ; sugarcrm ; {EXACT} ; (?:the )?sugarcrm public licen[sc]e
cpol-1.02 ; code project ; {EXACT} ; (?:the )?code project open licen[sc]e(?: {V1}| 1 02)?
proprietary ; trade secret ; {HINT} ; contains (?:confidential and )?(?:proprietary )?trade secrets? (?:and|or) (?:confidential|proprietary) information
non-commercial ; non commercial ; {HINT} ; for non ?commercial (?:use|purposes|research)(?: only)?
evaluation ; evaluation purposes ; {HINT} ; for (?:internal )?evaluation purposes only
no-derivatives ; derivative ; {HINT} ; you may not (?:modify|alter) or create derivative works(?: of| from| based on)?
reuse ; reuse software ; {LINK} ; reuse software(?: specification)?
spdx ; spdx org ; {LINK} ; spdx org licen[sc]es
proprietary ; proprietary ; {NAME} ; proprietary and confidential
proprietary ; unauthorized copying ; {NOTICE} ; unauthorized copying of this file via any medium is strictly prohibited
all-rights-reserved ; rights reserved ; {HINT} ; all rights reserved
no-warranty ; warrant ; {HINT} ; provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)
no-warranty ; warrant ; {HINT} ; without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
"""


def rules() -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, pattern) in order."""
    out = []
    for words in TAGGED:
        w = words.strip()
        first = w.split(" ")[0]
        label = f"{first}-{'.'.join(w.split(' ')[1:])}" if " " in w else first
        out.append((label, "spdx license identifier", TAG, rf" spdx license identifier {w}(?= )"))
    for line in WRITTEN.strip().split("\n"):
        label, keyword, priority, pattern = (x.strip() for x in line.split(" ; "))
        out.append((label, keyword, int(priority), rf" {pattern}(?= )"))
    return out


def _fixed(pattern: str) -> list[str]:
    """Parts of a pattern that don't vary: without groups, classes and optional characters."""
    left, sure = "", pattern
    while left != sure:
        left, sure = sure, re.sub(r"\((?:\?[:=])?[^()]*\)\??(?:\{[\d,]+\})?|\[[^]]*\][*+?]?|[^()\n][?*+]", "\n", sure)
    return sure.split("\n")


def needed(keyword: str, pattern: str) -> str:
    """Words that any match of the pattern holds: the keyword, or where spellings vary its words without them, or else the longest words that don't vary."""
    short = re.sub(r" ?\blicenses?\b.*", "", keyword)
    fixed, groups, inner, left = _fixed(pattern), [], pattern, ""
    while left != inner:  # from the innermost groups out
        groups += re.findall(r"\(\?:([^()]*)\)(?!\?)", inner)
        left, inner = inner, re.sub(r"\(\?[:=][^()]*\)\??", "\n", inner)
    for k in (keyword, short):
        if k and (any(k in x for x in fixed) or any(all(k in x for x in g.split("|")) for g in groups)):
            return k
    return max(fixed, key=len).strip()


def gates() -> list[str]:
    """Words of which any text that a rule matches holds at least one."""
    need = set()
    for _, keyword, _, pattern in rules():
        k = needed(keyword, pattern)
        need.add("licen" if "licen" in k or any("licen" in x for x in _fixed(pattern)) else k)
    return sorted(k for k in need if not any(o != k and o in k for o in need))
