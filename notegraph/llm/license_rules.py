"""The signatures of the license scan, each written for one license, one notice or one
sentence of a license text.

A line has keyword, label, priority, score and pattern.  Patterns are over lower-case words
with one space between; the keyword is a part of whatever the pattern matches, from the start of
a word.  Priority 3
is a notice or a text that names one license, 2 a name with its version or a whole title, 1 a
name that could be a mention, or a weak sign.  ``{v}`` stands for the ways to write
"version" before a number.
"""

from __future__ import annotations

SIGNATURES = r"""
spdx            | agpl-3.0        | 3 | 0.95 | spdx license identifier agpl 3 0(?: only| or later)?
agpl            | agpl-3.0        | 2 | 0.85 | agpl{v}3(?: 0)?(?: only| or later)?
agpl            | agpl            | 1 | 0.6  | agpl
affero          | agpl-3.0        | 2 | 0.9  | gnu affero general public license{v}3(?: 0)?(?: or later| or any later version| only)?
affero          | agpl-1.0        | 2 | 0.85 | affero general public license{v}1(?: 0)?
affero          | agpl            | 2 | 0.75 | gnu affero general public license
affero          | agpl            | 1 | 0.6  | affero gpl
interact with users | agpl-3.0    | 3 | 0.8  | if your software can interact with users remotely through a computer network
lesser g        | lgpl-3.0        | 2 | 0.9  | gnu lesser general public license{v}3(?: 0)?(?: or later| or any later version| only)?
lesser g        | lgpl-2.1        | 2 | 0.9  | gnu lesser general public license{v}2 1(?: or later| or any later version| only)?
lesser g        | lgpl            | 2 | 0.8  | gnu lesser general public license
lesser g        | lgpl            | 3 | 0.9  | redistribute it and or modify it under the terms of the gnu lesser general public license
lesser g        | lgpl            | 1 | 0.6  | lesser gpl
library general | lgpl-2.0        | 2 | 0.9  | gnu library general public license{v}2(?: 0)?
library general | lgpl-2.0        | 2 | 0.75 | gnu library general public license
spdx            | lgpl-3.0        | 3 | 0.95 | spdx license identifier lgpl 3 0(?: only| or later)?
spdx            | lgpl-2.1        | 3 | 0.95 | spdx license identifier lgpl 2 1(?: only| or later)?
spdx            | lgpl-2.0        | 3 | 0.95 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl            | lgpl-3.0        | 2 | 0.85 | lgpl{v}3(?: 0)?(?: only| or later)?
lgpl            | lgpl-2.1        | 2 | 0.85 | lgpl{v}2 1(?: only| or later)?
lgpl            | lgpl-2.0        | 2 | 0.8  | lgpl{v}2(?: 0)?
lgpl            | lgpl            | 1 | 0.6  | lgpl
spdx            | gpl-3.0         | 3 | 0.95 | spdx license identifier gpl 3 0(?: only| or later)?
spdx            | gpl-2.0         | 3 | 0.95 | spdx license identifier gpl 2 0(?: only| or later)?
spdx            | gpl-1.0         | 3 | 0.95 | spdx license identifier gpl 1 0(?: only| or later)?
gpl             | gpl-3.0         | 2 | 0.85 | gpl{v}3(?: 0)?(?: only| or later)?
gpl             | gpl-2.0         | 2 | 0.85 | gpl{v}2(?: 0)?(?: only| or later)?
gpl             | gpl             | 1 | 0.6  | (?:the |gnu )gpl
gpl             | gpl             | 3 | 0.85 | (?:licensed|released|distributed|published|available) under the (?:terms of the )?(?:gnu )?gpl
gpl             | gpl             | 2 | 0.75 | gpl compatible license
gnu general public | gpl-3.0         | 2 | 0.9  | gnu general public license{v}3(?: 0)?(?: or later| or any later version| only)?
gnu general public | gpl-2.0         | 2 | 0.9  | gnu general public license{v}2(?: 0)?(?: or later| or any later version| only)?
gnu general public | gpl-1.0         | 2 | 0.9  | gnu general public license{v}1(?: 0)?(?: or later| or any later version| only)?
gnu general public | gpl             | 2 | 0.75 | gnu general public license
gnu general public | gpl             | 3 | 0.9  | redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?
gnu general public | gpl             | 3 | 0.8  | you should have received a copy of the gnu general public license along with this program
gnu general public | gpl             | 3 | 0.8  | see the gnu general public license for more details
free software foundation | gpl             | 3 | 0.75 | as published by the free software foundation(?: either version \d of the license)?
copyleft        | gpl             | 1 | 0.4  | copyleft license
copyleft        | copyleft        | 1 | 0.3  | (?:strong|weak) copyleft
classpath       | gpl-classpath-exception | 2 | 0.85 | (?:gnu )?classpath exception(?: 2 0)?
font exception  | gpl-font-exception | 2 | 0.85 | gpl font exception|font exception to the gpl
gcc runtime     | gpl-gcc-exception | 2 | 0.85 | gcc runtime library exception(?: 3 1)?
bison exception | gpl-bison-exception | 2 | 0.85 | bison exception(?: 2 2)?
linking exception | gpl-linking-exception | 2 | 0.7  | linking exception
free documentation | gfdl-1.3        | 2 | 0.9  | gnu free documentation license{v}1 3
free documentation | gfdl-1.2        | 2 | 0.9  | gnu free documentation license{v}1 2
free documentation | gfdl-1.1        | 2 | 0.9  | gnu free documentation license{v}1 1
free documentation | gfdl            | 2 | 0.8  | gnu free documentation license
gfdl            | gfdl            | 1 | 0.6  | gfdl(?: 1 \d)?
spdx            | apache-2.0      | 3 | 0.95 | spdx license identifier apache 2 0
spdx            | apache-1.1      | 3 | 0.95 | spdx license identifier apache 1 1
apache          | apache-2.0      | 3 | 0.95 | licensed (?:to you )?under the apache license{v}2(?: 0)?
apache          | apache-2.0      | 2 | 0.9  | apache license{v}2(?: 0)?
apache          | apache-2.0      | 2 | 0.8  | apache{v}2 0(?: license)?
apache          | apache-1.1      | 2 | 0.9  | apache (?:software )?license{v}1 1
apache          | apache-1.0      | 2 | 0.9  | apache (?:software )?license{v}1 0
apache          | apache          | 1 | 0.6  | apache (?:software )?license
apache          | apache-2.0      | 3 | 0.9  | www apache org licenses license 2 0
asl 2           | apache-2.0      | 1 | 0.5  | asl 2 0
compliance with the license | apache-2.0      | 3 | 0.8  | you may not use this file except in compliance with the license
as is basis     | apache-2.0      | 2 | 0.6  | distributed on an as is basis without warranties or conditions of any kind
llvm exception  | llvm-exception  | 2 | 0.9  | (?:apache 2 0 with )?llvm exceptions?
spdx            | mit             | 3 | 0.95 | spdx license identifier mit
mit license     | mit             | 3 | 0.9  | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?mit license
mit license     | mit             | 2 | 0.75 | (?:the )?mit license|mit licensed
opensource      | mit             | 3 | 0.9  | opensource org licenses mit
mit no attribution | mit-0           | 2 | 0.9  | mit no attribution(?: license)?
mit 0 license   | mit-0           | 2 | 0.9  | mit 0 license
mit license     | mit-modern      | 2 | 0.85 | mit license modern variant
enlightenment   | mit-advertising | 2 | 0.85 | enlightenment license mit
mit license     | mit-advertising | 2 | 0.85 | mit license with advertising clause
mit x11         | x11             | 2 | 0.85 | mit x11(?: license)?
x11 license     | x11             | 2 | 0.8  | x11 license
expat license   | mit             | 2 | 0.85 | expat license
permission is hereby granted | mit             | 3 | 0.9  | permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
permission notice shall | mit             | 3 | 0.8  | copyright notice and this permission notice shall be included in all copies or substantial portions
jsonlicense     | json            | 2 | 0.7  | jsonlicense
good not evil   | json            | 3 | 0.9  | shall be used for good not evil
spdx            | bsd-2-clause    | 3 | 0.95 | spdx license identifier bsd 2 clause
spdx            | bsd-3-clause    | 3 | 0.95 | spdx license identifier bsd 3 clause
bsd             | bsd-2-clause    | 2 | 0.9  | (?:simplified|2 clause|two clause) bsd(?: license)?|bsd (?:2|two) clause(?: license)?
freebsd         | bsd-2-clause-freebsd | 2 | 0.9  | freebsd license|bsd 2 clause freebsd(?: license)?
bsd             | bsd-3-clause    | 2 | 0.9  | (?:new|modified|revised|3 clause|three clause) bsd(?: license)?|bsd (?:3|three) clause(?: license)?
bsd             | bsd-3-clause-clear | 2 | 0.9  | bsd 3 clause clear license|clear bsd license
bsd             | bsd-4-clause    | 2 | 0.9  | (?:original|4 clause|four clause) bsd(?: license)?|bsd (?:4|four) clause(?: license)?
bsd             | bsd-1-clause    | 2 | 0.9  | (?:1|one) clause bsd(?: license)?|bsd (?:1|one) clause(?: license)?
bsd             | 0bsd            | 2 | 0.9  | zero clause bsd(?: license)?
0bsd            | 0bsd            | 2 | 0.9  | 0bsd
bsd             | bsd-patent      | 2 | 0.9  | bsd 2 clause plus patent(?: license)?
bsd             | bsd             | 1 | 0.6  | bsd (?:style )?license|bsd licensed
bsd             | bsd-protection  | 2 | 0.85 | bsd protection license
redistribution and use | bsd             | 3 | 0.9  | redistribution and use in source and binary forms with or without modification are permitted
endorse or promote | bsd-3-clause    | 3 | 0.85 | may be used to endorse or promote products derived from this software without specific prior written permission
advertising materials | bsd-4-clause    | 3 | 0.85 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
redistributions of source code | bsd             | 3 | 0.75 | redistributions of source code must retain the above copyright notice
redistributions in binary form | bsd             | 3 | 0.75 | redistributions in binary form must reproduce the above copyright notice
mozilla public  | mpl-2.0         | 2 | 0.9  | mozilla public license{v}2(?: 0)?
mozilla public  | mpl-1.1         | 2 | 0.9  | mozilla public license{v}1 1
mozilla public  | mpl-1.0         | 2 | 0.9  | mozilla public license{v}1 0
mozilla public  | mpl             | 2 | 0.75 | mozilla public license
spdx            | mpl-2.0         | 3 | 0.95 | spdx license identifier mpl 2 0
mpl             | mpl-2.0         | 2 | 0.8  | mpl{v}2(?: 0)?
mpl             | mpl-1.1         | 2 | 0.8  | mpl{v}1 1
mpl             | mpl-2.0         | 3 | 0.9  | if a copy of the mpl was not distributed with this file you can obtain one at
eclipse public  | epl-2.0         | 2 | 0.9  | eclipse public license{v}2(?: 0)?
eclipse public  | epl-1.0         | 2 | 0.9  | eclipse public license{v}1(?: 0)?
eclipse public  | epl             | 2 | 0.75 | eclipse public license
eclipse distribution | edl-1.0         | 2 | 0.9  | eclipse distribution license(?:{v}1 0)?
epl             | epl-2.0         | 2 | 0.8  | epl{v}2 0
epl             | epl-1.0         | 2 | 0.8  | epl{v}1 0
common public license | cpl-1.0         | 2 | 0.9  | common public license(?:{v}1 0)?
ibm public      | ipl-1.0         | 2 | 0.9  | ibm public license(?:{v}1 0)?
european union public | eupl-1.2        | 2 | 0.9  | european union public licen[cs]e{v}1 2
european union public | eupl-1.1        | 2 | 0.9  | european union public licen[cs]e{v}1 1
european union public | eupl            | 2 | 0.75 | european union public licen[cs]e
eupl            | eupl            | 1 | 0.6  | eupl(?:{v}1 \d)?
common development | cddl-1.1        | 2 | 0.9  | common development and distribution license{v}1 1
common development | cddl-1.0        | 2 | 0.9  | common development and distribution license{v}1 0
common development | cddl            | 2 | 0.75 | common development and distribution license
cddl            | cddl            | 1 | 0.6  | cddl(?: 1 \d)?
artistic license | artistic-2.0    | 2 | 0.9  | artistic license{v}2(?: 0)?
artistic license | artistic-1.0    | 2 | 0.85 | (?:perl|clarified) artistic license|artistic license{v}1 0
artistic license | artistic        | 1 | 0.6  | artistic license
same terms as perl | perl            | 3 | 0.9  | under the same terms as perl itself
ruby license    | ruby            | 2 | 0.8  | ruby license
php license     | php-3.01        | 2 | 0.9  | php license{v}3 01
php license     | php             | 1 | 0.6  | php license
python software | python-2.0      | 2 | 0.9  | python software foundation license{v}2(?: 0)?
python software | psf             | 2 | 0.8  | python software foundation license
cnri            | cnri-python     | 2 | 0.8  | cnri open source (?:gpl compatible )?license agreement
zope public     | zpl-2.1         | 2 | 0.9  | zope public license(?:{v}2 \d)?
qt public       | qpl-1.0         | 2 | 0.9  | qt public license(?:{v}1 0)?
tcl tk          | tcl             | 2 | 0.8  | tcl tk license
w3c             | w3c             | 2 | 0.85 | w3c software (?:notice and )?(?:and document )?(?:notice and )?license
vim license     | vim             | 2 | 0.8  | vim license
openssl license | openssl         | 2 | 0.85 | openssl license
ssleay          | ssleay          | 2 | 0.85 | ssleay license
curl license    | curl            | 2 | 0.8  | curl license
libpng          | libpng-2.0      | 2 | 0.9  | libpng license{v}2(?: 0)?
libpng          | libpng          | 2 | 0.8  | libpng license
libtiff         | libtiff         | 2 | 0.85 | libtiff license
ijg             | ijg             | 2 | 0.8  | (?:independent jpeg group|ijg) ijg license|ijg license
freetype        | ftl             | 2 | 0.85 | freetype (?:project )?license
imagemagick     | imagemagick     | 2 | 0.85 | imagemagick license
info zip        | info-zip        | 2 | 0.85 | info zip license
bzip2           | bzip2-1.0.6     | 2 | 0.85 | bzip2 (?:and libbzip2 )?license
sleepycat       | sleepycat       | 2 | 0.85 | sleepycat license
postgresql license | postgresql      | 2 | 0.85 | postgresql license
spdx            | isc             | 3 | 0.95 | spdx license identifier isc
isc license     | isc             | 2 | 0.8  | isc license|isc licensed
permission to use copy modify | isc             | 3 | 0.9  | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
permission to use copy modify | hpnd            | 3 | 0.85 | permission to use copy modify and distribute this software and its documentation for any purpose
historical permission | hpnd            | 2 | 0.85 | historical permission notice and disclaimer
spdx            | zlib            | 3 | 0.95 | spdx license identifier zlib
zlib            | zlib            | 2 | 0.8  | zlib license
zlib            | zlib            | 2 | 0.85 | zlib libpng license
origin of this software | zlib            | 3 | 0.9  | the origin of this software must not be misrepresented
altered source  | zlib            | 3 | 0.85 | altered source versions must be plainly marked as such
boost software  | boost-1.0       | 2 | 0.9  | boost software license{v}1(?: 0)?
boost software  | boost-1.0       | 2 | 0.8  | boost software license
spdx            | boost-1.0       | 3 | 0.95 | spdx license identifier bsl 1 0
business source | busl-1.1        | 2 | 0.9  | business source license(?:{v}1 1)?
server side public | sspl-1.0        | 2 | 0.9  | server side public license(?:{v}1)?
elastic license | elastic-2.0     | 2 | 0.9  | elastic license{v}2(?: 0)?
elastic license | elastic         | 2 | 0.75 | elastic license
commons clause  | commons-clause  | 2 | 0.9  | commons clause(?: license condition)?
polyform        | polyform-noncommercial | 2 | 0.9  | polyform noncommercial license(?: 1 0 0)?
polyform        | polyform-small-business | 2 | 0.9  | polyform small business license(?: 1 0 0)?
confluent community | confluent       | 2 | 0.85 | confluent community license
redis source    | rsal            | 2 | 0.85 | redis source available license
timescale license | tsl             | 2 | 0.85 | timescale license
hippocratic license | hippocratic     | 2 | 0.85 | hippocratic license
anti 996        | anti-996        | 2 | 0.85 | anti 996 license
academic free   | afl-3.0         | 2 | 0.9  | academic free license{v}3(?: 0)?
academic free   | afl             | 2 | 0.75 | academic free license
open software license | osl-3.0         | 2 | 0.9  | open software license{v}3(?: 0)?
open software license | osl             | 2 | 0.75 | open software license
educational community | ecl-2.0         | 2 | 0.9  | educational community license(?:{v}2 0)?
university of illinois | ncsa            | 2 | 0.9  | university of illinois ncsa open source license
ncsa            | ncsa            | 1 | 0.6  | ncsa license
microsoft public | ms-pl           | 2 | 0.9  | microsoft public license
microsoft reciprocal | ms-rl           | 2 | 0.9  | microsoft reciprocal license
apple public    | apsl-2.0        | 2 | 0.9  | apple public source license(?:{v}2 0)?
sun public      | spl-1.0         | 2 | 0.9  | sun public license
sun industry    | sissl           | 2 | 0.9  | sun industry standards source license
lucent public   | lpl-1.02        | 2 | 0.9  | lucent public license
nasa open       | nasa-1.3        | 2 | 0.9  | nasa open source agreement(?: 1 3)?
nokia open      | nokia           | 2 | 0.85 | nokia open source license
netscape public | npl-1.1         | 2 | 0.9  | netscape public license(?:{v}1 \d)?
intel open      | intel           | 2 | 0.85 | intel open source license
sybase open     | watcom-1.0      | 2 | 0.85 | sybase open watcom public license
realnetworks    | rpsl-1.0        | 2 | 0.85 | realnetworks public source license
reciprocal public | rpl-1.5         | 2 | 0.9  | reciprocal public license(?: 1 5)?
common public attribution | cpal-1.0        | 2 | 0.9  | common public attribution license
adaptive public | apl-1.0         | 2 | 0.9  | adaptive public license
cecill          | cecill-2.1      | 2 | 0.9  | cecill free software license agreement|cecill{v}2 1
cecill          | cecill-b        | 2 | 0.9  | cecill b
cecill          | cecill-c        | 2 | 0.9  | cecill c
cecill          | cecill          | 1 | 0.6  | cecill license
mulan p         | mulanpsl-2.0    | 2 | 0.9  | mulan (?:permissive software license|psl){v}2
spdx            | upl-1.0         | 3 | 0.95 | spdx license identifier upl 1 0
universal permissive | upl-1.0         | 2 | 0.9  | universal permissive license(?:{v}1 0)?
blue oak        | blueoak-1.0.0   | 2 | 0.9  | blue oak model license(?: 1 0 0)?
fair license    | fair            | 2 | 0.7  | fair license
beerware        | beerware        | 2 | 0.9  | beerware(?: license)?
buy me a beer   | beerware        | 3 | 0.9  | you can buy me a beer in return
do what the     | wtfpl           | 2 | 0.9  | do what the \w+ you want to public license
wtfpl           | wtfpl           | 2 | 0.8  | wtfpl
unlicense       | unlicense       | 2 | 0.85 | (?:the )?unlicense
free and unencumbered | unlicense       | 3 | 0.95 | this is free and unencumbered software released into the public domain
public domain   | public-domain   | 3 | 0.85 | (?:released|dedicated|placed|put) (?:in|to|into) the public domain
public domain   | public-domain   | 1 | 0.5  | public domain
public domain   | pddl-1.0        | 2 | 0.9  | public domain dedication and license
sqlite blessing | blessing        | 2 | 0.85 | sqlite blessing
may you do good | blessing        | 3 | 0.9  | may you do good and not evil
spdx            | cc0-1.0         | 3 | 0.95 | spdx license identifier cc0 1 0
cc0             | cc0-1.0         | 2 | 0.8  | cc0(?: 1 0)?(?: universal)?
cc zero         | cc0-1.0         | 2 | 0.8  | (?:creative commons )?cc zero
commons zero    | cc0-1.0         | 2 | 0.9  | creative commons zero(?:{v}1 0)?(?: universal)?
cc by           | cc-by-nc-sa     | 2 | 0.85 | cc by nc sa(?: \d \d)?
cc by           | cc-by-nc-nd     | 2 | 0.85 | cc by nc nd(?: \d \d)?
cc by           | cc-by-nc        | 2 | 0.85 | cc by nc(?: \d \d)?
cc by           | cc-by-nd        | 2 | 0.85 | cc by nd(?: \d \d)?
cc by           | cc-by-sa        | 2 | 0.85 | cc by sa(?: \d \d)?
cc by           | cc-by-4.0       | 2 | 0.85 | cc by 4 0
cc by           | cc-by-3.0       | 2 | 0.85 | cc by 3 0
cc by           | cc-by-2.5       | 2 | 0.85 | cc by 2 5
cc by           | cc-by-2.0       | 2 | 0.85 | cc by 2 0
creative commons | cc-by-nc-sa     | 2 | 0.9  | creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: international| unported)?
creative commons | cc-by-nc-nd     | 2 | 0.9  | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: \d \d)?(?: international| unported)?
creative commons | cc-by-nc        | 2 | 0.9  | creative commons attribution non ?commercial(?: \d \d)?(?: international| unported)?
creative commons | cc-by-nd        | 2 | 0.9  | creative commons attribution no ?deriv(?:ative)?s?(?: \d \d)?(?: international| unported)?
creative commons | cc-by-sa        | 2 | 0.9  | creative commons attribution share ?alike(?: \d \d)?(?: international| unported)?
creative commons | cc-by-4.0       | 2 | 0.9  | creative commons attribution 4 0(?: international)?
creative commons | cc-by-3.0       | 2 | 0.9  | creative commons attribution 3 0(?: unported)?
creative commons | cc              | 1 | 0.6  | creative commons(?: license)?
creativecommons | cc-by-4.0       | 3 | 0.95 | creativecommons org licenses by 4 0
creativecommons | cc-by-sa        | 3 | 0.95 | creativecommons org licenses by sa \d \d
creativecommons | cc-by-nc        | 3 | 0.95 | creativecommons org licenses by nc \d \d
creativecommons | cc0-1.0         | 3 | 0.95 | creativecommons org publicdomain zero 1 0
open database   | odbl-1.0        | 2 | 0.9  | (?:odc )?open database license(?:{v}1 0)?
odbl            | odbl-1.0        | 2 | 0.8  | odbl(?:{v}1 0)?
odc             | odc-by-1.0      | 2 | 0.85 | odc (?:by|attribution)(?: license)?(?: 1 0)?
open government | ogl-uk-3.0      | 2 | 0.9  | open government licen[cs]e(?:{v}3 0)?
etalab          | etalab-2.0      | 2 | 0.85 | etalab open license(?: 2 0)?
data license germany | dl-de-by-2.0    | 2 | 0.85 | data license germany attribution(?:{v}2 0)?
community data license | cdla-permissive | 2 | 0.9  | community data license agreement permissive
community data license | cdla-sharing    | 2 | 0.9  | community data license agreement sharing
open font       | ofl-1.1         | 2 | 0.9  | (?:sil )?open font license(?:{v}1 1)?
bitstream vera  | bitstream-vera  | 2 | 0.85 | bitstream vera fonts? (?:copyright|license)
ubuntu font     | ufl-1.0         | 2 | 0.85 | ubuntu font licen[cs]e
free art        | lal-1.3         | 2 | 0.85 | free art license(?: 1 3)?
design science  | dsl             | 2 | 0.85 | design science license
open publication | opl-1.0         | 2 | 0.85 | open publication license
open content    | opencontent     | 2 | 0.7  | open content license
openrail        | openrail        | 2 | 0.85 | (?:creativeml |bigscience |bigcode )?openrail(?: m| m1| license)?
llama           | llama           | 2 | 0.85 | llama \d (?:\d )?community license(?: agreement)?
gemma terms     | gemma           | 2 | 0.85 | gemma terms of use
rail license    | rail            | 2 | 0.7  | responsible ai (?:rail )?rail license|rail license
academic use    | noncommercial   | 2 | 0.6  | for academic use only|academic use license
non commercial use | noncommercial   | 2 | 0.7  | (?:for|permits) non commercial use only
noncommercial purposes | noncommercial   | 2 | 0.6  | for noncommercial purposes only
personal use only | noncommercial   | 2 | 0.6  | for personal use only
research purposes only | noncommercial   | 2 | 0.6  | for research purposes only
evaluation purposes | commercial      | 2 | 0.6  | for evaluation purposes only
end user license | commercial      | 2 | 0.75 | end user license agreement
eula            | commercial      | 2 | 0.7  | eula
commercial license | commercial      | 1 | 0.5  | commercial license(?: agreement)?
dual licensed   | dual            | 1 | 0.4  | dual licensed
site license    | commercial      | 1 | 0.4  | site license
shareware       | shareware       | 1 | 0.5  | shareware
freeware        | freeware        | 1 | 0.5  | freeware
proprietary and confidential | proprietary     | 2 | 0.85 | proprietary and confidential
confidential information | proprietary     | 1 | 0.4  | confidential information of
all rights reserved | proprietary     | 1 | 0.4  | all rights reserved
unauthorized copying | proprietary     | 3 | 0.85 | unauthorized copying of this (?:file|software|document)
no part of this | proprietary     | 3 | 0.8  | no part of this (?:publication|book|document|work) may be reproduced
reproduction prohibited | proprietary     | 2 | 0.6  | reproduction prohibited
without warranty | no-warranty     | 1 | 0.3  | without warranty of any kind(?: express or implied)?
merchantability | no-warranty     | 1 | 0.3  | warrant(?:y|ies) of merchantability(?: and| or)? fitness for a particular purpose
in no event shall | no-liability    | 1 | 0.3  | in no event shall the (?:authors?|copyright holders?|contributors?)
attribution required | attribution     | 1 | 0.4  | attribution required
patent license  | patent          | 1 | 0.4  | perpetual worldwide non exclusive no charge royalty free irrevocable (?:\w+ ){0,6}patent license
open source license | open-source     | 1 | 0.3  | (?:osi approved )?open source license
"""


def rules() -> list[tuple[str, str, int, float, str]]:
    """(label, keyword, priority, score, pattern) in order; patterns are over words with
    a single space on either side."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        keyword, label, priority, score, pattern = (part.strip() for part in line.split("|", 4))
        out.append((label, keyword, int(priority), float(score), f"(?<= )(?:{pattern.replace('{v}', '(?: version| v)? ?v?')})(?= )"))
    return out
