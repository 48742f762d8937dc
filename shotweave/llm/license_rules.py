"""The signature rules of the license scan, in order of priority.

A rule is written over lower-case words that stand one blank apart. Each line of a section holds label; weight; keyword;
pattern. A pattern runs only on texts that hold its keyword as whole words. Where a pattern has a group, the group is the interval that is
reported. Sections, and lines within them, go from the most specific to the least.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed phrases and labels of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int  # less is better
    weight: float


#: Sentences of license texts and of the headers that refer to them.
TEXTS = r"""
mit; 1.0; permission is hereby granted; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; 0.9; permission is hereby granted; permission is hereby granted free of charge to any person obtaining a copy
mit-0; 0.9; without restriction; to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit; 0.9; without restriction; to deal in the software without restriction including without limitation the rights
mit; 0.8; substantial portions; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc; 1.0; permission to use copy; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
isc; 0.9; permission to use copy; permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
hpnd; 0.9; permission to use copy; permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
0bsd; 0.9; permission to use copy; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
bsd-4-clause; 1.0; advertising materials; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause; 1.0; endorse or promote; neither the names? of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-3-clause; 0.9; endorse or promote; may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission
bsd; 0.9; redistribution and use; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd; 0.8; redistribution and use; redistribution and use in source and binary forms with or without modification
bsd; 0.7; redistributions of source; redistributions of source code must retain the above copyright notice this list of conditions
bsd; 0.7; redistributions in binary; redistributions in binary form must reproduce the above copyright notice
zlib; 1.0; origin of this software; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; 0.8; altered source; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
apache-2.0; 1.0; compliance with the license; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0; 0.9; apache org; (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0; 0.8; compliance with the license; you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0; 0.9; terms and conditions for use; apache license version 2 0 january 2004
apache-1.1; 0.9; apache software foundation; this product includes software developed by the apache software foundation
gpl-3.0; 1.0; free software foundation; gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0; 1.0; free software foundation; gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0; 1.0; free software foundation; gnu general public license version 2 as published by the free software foundation
gpl-3.0; 1.0; 29 june 2007; gnu general public license version 3 29 june 2007
gpl-2.0; 1.0; june 1991; gnu general public license version 2 june 1991
gpl-1.0; 1.0; february 1989; gnu general public license version 1 february 1989
gpl; 0.8; free software foundation; you should have received a copy of the gnu general public license along with this program
gpl; 0.7; freedom to share; the gnu general public license is intended to guarantee your freedom to share and change
lgpl-3.0; 1.0; free software foundation; gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl-2.1; 1.0; free software foundation; gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-2.0; 1.0; free software foundation; gnu library general public license as published by the free software foundation either version 2 of the license
lgpl; 0.8; free software foundation; you should have received a copy of the gnu lesser general public license along with this library
agpl-3.0; 1.0; free software foundation; gnu affero general public license as published by the free software foundation either version 3 of the license
agpl-3.0; 1.0; 19 november 2007; gnu affero general public license version 3 19 november 2007
agpl; 0.8; remote network; users interacting with it remotely through a computer network
gfdl; 0.9; invariant sections; with no invariant sections no front cover texts and no back cover texts
mpl-2.0; 1.0; mozilla public; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0; 0.9; mozilla org; (?:https? )?mozilla org mpl 2 0
mpl-1.1; 1.0; mozilla public; the contents of this file are subject to the mozilla public license version 1 1
epl-2.0; 1.0; eclipse public; this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1.0; 1.0; eclipse public; this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl; 0.8; eclipse org; (?:https? )?(?:www )?eclipse org legal epl (?:v10|2 0)(?: html)?
cddl; 0.9; common development; the contents of this file are subject to the terms of the common development and distribution license
eupl-1.2; 0.9; licensed under the eupl; licensed under the eupl version 1 2
eupl; 0.8; licensed under the eupl; licensed under the eupl
boost-1.0; 1.0; boost software; distributed under the boost software license version 1 0
boost-1.0; 0.9; boost org; (?:https? )?(?:www )?boost org license 1 0 txt
artistic-2.0; 0.9; package; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package
artistic-1.0; 0.9; artistic control; such that the copyright holder maintains some semblance of artistic control over the development of the package
unlicense; 1.0; unencumbered; this is free and unencumbered software released into the public domain
unlicense; 0.9; unlicense org; (?:https? )?(?:www )?unlicense org
cc0-1.0; 1.0; related or neighboring; has waived all copyright and related or neighboring rights to
cc0-1.0; 1.0; creativecommons org; (?:https? )?creativecommons org publicdomain zero 1 0
cc-pdm; 0.9; creativecommons org; (?:https? )?creativecommons org publicdomain mark 1 0
wtfpl; 1.0; do what the; you just do what the fuck you want to
wtfpl; 1.0; do what the; do what the fuck you want to public license(?: version 2)?
beerware; 1.0; a beer; if we meet some day and you think this stuff is worth it you can buy me a beer in return
json; 1.0; good not evil; the software shall be used for good not evil
ofl-1.1; 1.0; open font; this font software is licensed under the sil open font license version 1 1
ofl; 0.8; scripts sil org; (?:https? )?scripts sil org ofl
psf-2.0; 0.9; python software; this license agreement is between the python software foundation psf
openssl; 1.0; openssl; this product includes software developed by the openssl project
curl; 0.9; daniel stenberg; copyright c 1996 (?:20\d\d )?daniel stenberg
x11; 0.9; x consortium; except as contained in this notice the name of the x consortium shall not be used in advertising
libpng; 0.9; png; this copy of the libpng notices is provided for your convenience
ijg; 0.9; independent jpeg; this software is based in part on the work of the independent jpeg group
ncsa; 0.9; university of illinois; developed by .{1,60}? university of illinois
sqlite-blessing; 1.0; do good and not evil; may you do good and not evil
ms-pl; 0.9; microsoft public; this license governs use of the accompanying software if you use the software you accept this license
bsl-1.1; 0.9; business source; use limitation the licensed work is provided under the business source license
elastic-2.0; 0.9; hosted or managed; you may not provide the software to third parties as a hosted or managed service
sspl-1.0; 0.9; functionality of the program; if you make the functionality of the program or a modified version available to third parties as a service
commons-clause; 0.9; commons clause; the grant of rights under the license will not include and the license does not grant to you the right to sell the software
openrail; 0.9; use based restrictions; you shall not use the model or derivatives of the model .{0,40}?use based restrictions
llama; 0.9; community license; is licensed under the llama \d(?: \d)? community license
"""
#: Full names with a version.
VERSIONS = r"""
lgpl-3.0; 1.0; lesser general; (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?(?: only| or later)?
lgpl-2.1; 1.0; lesser general; (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1(?: only| or later)?
lgpl-2.0; 1.0; lesser general; (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2(?: 0)?(?! 1)
lgpl-2.0; 1.0; library general; (?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)?
agpl-3.0; 1.0; affero; (?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?
agpl-1.0; 1.0; affero; affero general public licen[cs]e(?: version| v)? ?1(?: 0)?
gpl-3.0; 1.0; general public; (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?3(?: 0)?(?: only| or later)?
gpl-2.0; 1.0; general public; (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?2(?: 0)?(?: only| or later)?
gpl-1.0; 1.0; general public; (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?1(?: 0)?(?: only| or later)?
lgpl-3.0; 0.9; lgpl; (?:gnu )?lgpl (?:version |v)?3(?: 0)?(?: only| or later)?
lgpl-2.1; 0.9; lgpl; (?:gnu )?lgpl (?:version |v)?2 1(?: only| or later)?
agpl-3.0; 0.9; agpl; (?:gnu )?agpl (?:version |v)?3(?: 0)?(?: only| or later)?
gpl-3.0; 0.9; gpl; (?:gnu )?gpl (?:version |v)?3(?: 0)?(?: only| or later)?
gpl-2.0; 0.9; gpl; (?:gnu )?gpl (?:version |v)?2(?: 0)?(?: only| or later)?
lgpl-3.0; 0.9; lgplv3; lgplv3
lgpl-2.1; 0.9; lgplv2; lgplv2 1
agpl-3.0; 0.9; agplv3; agplv3
gpl-3.0; 0.9; gplv3; (?:gnu )?gplv3(?: 0)?
gpl-2.0; 0.9; gplv2; (?:gnu )?gplv2(?: 0)?
gfdl-1.3; 1.0; documentation license; (?:gnu )?free documentation license(?: version| v)? ?1 3
gfdl-1.2; 1.0; documentation license; (?:gnu )?free documentation license(?: version| v)? ?1 2
gfdl-1.1; 1.0; documentation license; (?:gnu )?free documentation license(?: version| v)? ?1 1
apache-2.0; 1.0; apache; apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-1.1; 1.0; apache; apache(?: software)? licen[cs]e(?: version| v)? ?1 1
apache-1.0; 1.0; apache; apache(?: software)? licen[cs]e(?: version| v)? ?1 0
apache-2.0; 0.9; apache; apache ?v?2 0
mpl-2.0; 1.0; mozilla; mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
mpl-1.1; 1.0; mozilla; mozilla public licen[cs]e(?: version| v)? ?1 1
mpl-1.0; 1.0; mozilla; mozilla public licen[cs]e(?: version| v)? ?1 0
epl-2.0; 1.0; eclipse; eclipse public licen[cs]e(?: version| v)? ?2 0
epl-1.0; 1.0; eclipse; eclipse public licen[cs]e(?: version| v)? ?1 0
eupl-1.2; 1.0; european union; european union public licen[cs]e(?: version| v)? ?1 2
eupl-1.1; 1.0; european union; european union public licen[cs]e(?: version| v)? ?1 1
eupl-1.0; 1.0; european union; european union public licen[cs]e(?: version| v)? ?1 0
cddl-1.1; 1.0; common development; common development and distribution licen[cs]e(?: cddl)?(?: version| v)? ?1 1
cddl-1.0; 1.0; common development; common development and distribution licen[cs]e(?: cddl)?(?: version| v)? ?1 0
cpl-1.0; 1.0; common public; common public licen[cs]e(?: version| v)? ?1 0
cpal-1.0; 1.0; common public attribution; common public attribution licen[cs]e(?: version| v)? ?1 0
ipl-1.0; 1.0; ibm public; ibm public licen[cs]e(?: version| v)? ?1 0
artistic-2.0; 1.0; artistic; (?:the )?artistic licen[cs]e(?: version| v)? ?2(?: 0)?
artistic-1.0; 1.0; artistic; (?:the )?artistic licen[cs]e(?: version| v)? ?1(?: 0)?
boost-1.0; 1.0; boost; boost software licen[cs]e(?: version| v)? ?1 0
osl-3.0; 1.0; open software; open software licen[cs]e(?: version| v)? ?3 0
osl-2.1; 1.0; open software; open software licen[cs]e(?: version| v)? ?2 1
afl-3.0; 1.0; academic free; academic free licen[cs]e(?: version| v)? ?3 0
afl-2.1; 1.0; academic free; academic free licen[cs]e(?: version| v)? ?2 1
odbl-1.0; 1.0; open database; open (?:data commons open )?database licen[cs]e(?: odbl)?(?: version| v)? ?1 0
odc-by-1.0; 1.0; open data commons; open data commons attribution licen[cs]e(?: odc by)?(?: version| v)? ?1 0
pddl-1.0; 1.0; public domain dedication; (?:open data commons )?public domain dedication (?:and|amp) licen[cs]e(?: pddl)?(?: version| v)?(?: 1 0)?
ofl-1.1; 1.0; open font; (?:sil )?open font licen[cs]e(?: ofl)?(?: version| v)? ?1 1
ofl-1.0; 1.0; open font; (?:sil )?open font licen[cs]e(?: ofl)?(?: version| v)? ?1 0
lppl-1.3c; 1.0; latex project; latex project public licen[cs]e(?: version| v)? ?1 3(?: ?c)?
lppl-1.2; 1.0; latex project; latex project public licen[cs]e(?: version| v)? ?1 2
zpl-2.1; 1.0; zope; zope public licen[cs]e(?: zpl)?(?: version| v)? ?2 1
zpl-2.0; 1.0; zope; zope public licen[cs]e(?: zpl)?(?: version| v)? ?2 0
psf-2.0; 1.0; python software; python software foundation licen[cs]e(?: version| v)? ?2(?: 0)?
php-3.01; 1.0; php; php licen[cs]e(?: version| v)? ?3 01
php-3.0; 1.0; php; php licen[cs]e(?: version| v)? ?3 0
w3c; 1.0; w3c; w3c software (?:and document )?notice and licen[cs]e
upl-1.0; 1.0; universal permissive; universal permissive licen[cs]e(?: upl)?(?: version| v)? ?1 0
ecl-2.0; 1.0; educational community; educational community licen[cs]e(?: version| v)? ?2 0
mulan-2.0; 1.0; mulan; mulan (?:psl|permissive software licen[cs]e)(?: version| v)? ?2
bsl-1.1; 1.0; business source; business source licen[cs]e(?: version| v)? ?1 1
sspl-1.0; 1.0; server side public; server side public licen[cs]e(?: version| v)? ?1
elastic-2.0; 1.0; elastic; elastic licen[cs]e(?: version| v)? ?2 0
polyform; 0.9; polyform; polyform (?:noncommercial|small business|strict|shield|free trial|internal use|perimeter) licen[cs]e(?: 1 0 0)?
parity-7.0; 0.9; parity; parity public licen[cs]e(?: version)? ?7 0
ms-pl; 1.0; microsoft; microsoft public licen[cs]e(?: ms pl)?
ms-rl; 1.0; microsoft; microsoft reciprocal licen[cs]e(?: ms rl)?
apsl-2.0; 1.0; apple public; apple public source licen[cs]e(?: version| v)? ?2 0
qpl-1.0; 1.0; q public; q public licen[cs]e(?: version| v)? ?1 0
sleepycat; 1.0; sleepycat; sleepycat licen[cs]e
cecill-2.1; 1.0; cecill; cecill (?:free software licen[cs]e agreement )?(?:version |v)?2 1
cecill-b; 1.0; cecill; cecill b
cecill-c; 1.0; cecill; cecill c
bsd-4-clause; 1.0; bsd; (?:original |4 clause |four clause )bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?
bsd-3-clause; 1.0; bsd; (?:new |modified |revised |3 clause |three clause )bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?
bsd-2-clause; 1.0; bsd; (?:simplified |freebsd |2 clause |two clause )bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?
0bsd; 1.0; bsd; (?:zero clause |0 clause )bsd licen[cs]e|bsd zero clause(?: licen[cs]e)?
openrail-m; 0.9; openrail; (?:creativeml |bigscience )?open ?rail m(?: licen[cs]e)?
cc0-1.0; 1.0; cc0; cc0 1 0(?: universal)?(?: public domain dedication)?
cc0-1.0; 1.0; creative commons zero; creative commons zero(?: v)? ?1 0(?: universal)?
"""
#: Creative Commons, where the parts of a name are told by the words themselves: V stands for each version.
CC_VERSIONED = """
cc-by-nc-sa-V; 1.0; cc by; cc by nc sa V(?: international| intl)?
cc-by-nc-nd-V; 1.0; cc by; cc by nc nd V(?: international| intl)?
cc-by-nc-V; 1.0; cc by; cc by nc V(?: international| intl)?
cc-by-sa-V; 1.0; cc by; cc by sa V(?: international| intl)?
cc-by-nd-V; 1.0; cc by; cc by nd V(?: international| intl)?
cc-by-V; 1.0; cc by; cc by V(?: international| intl)?
cc-by-nc-sa-V; 1.0; creative commons; creative commons attribution non ?commercial share ?alike V(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-nd-V; 1.0; creative commons; creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? V(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-V; 1.0; creative commons; creative commons attribution non ?commercial V(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa-V; 1.0; creative commons; creative commons attribution share ?alike V(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nd-V; 1.0; creative commons; creative commons attribution no ?deriv(?:ative)?s(?: works)? V(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-V; 1.0; creative commons; creative commons attribution V(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa-V; 1.0; creativecommons org; (?:https? )?creativecommons org licenses by nc sa V
cc-by-nc-nd-V; 1.0; creativecommons org; (?:https? )?creativecommons org licenses by nc nd V
cc-by-nc-V; 1.0; creativecommons org; (?:https? )?creativecommons org licenses by nc V
cc-by-sa-V; 1.0; creativecommons org; (?:https? )?creativecommons org licenses by sa V
cc-by-nd-V; 1.0; creativecommons org; (?:https? )?creativecommons org licenses by nd V
cc-by-V; 1.0; creativecommons org; (?:https? )?creativecommons org licenses by V
"""
CC_VERSIONS = ["4.0", "3.0", "2.5", "2.0", "1.0"]
# SPDX license identifiers.
SPDX = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 Beerware Blessing
BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-1.0
CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND IJG IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.1 LGPL-3.0 libpng-2.0
LPPL-1.2 LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1
OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 Unicode-3.0
Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.0 ZPL-2.1
"""
#: Names without a version.
NAMES = r"""
lgpl; 0.8; lesser general; (?:gnu )?lesser general public licen[cs]e
lgpl; 0.8; library general; (?:gnu )?library general public licen[cs]e
agpl; 0.8; affero; (?:gnu )?affero general public licen[cs]e
gfdl; 0.8; documentation license; (?:gnu )?free documentation license
sspl; 0.8; server side public; server side public licen[cs]e
gpl; 0.7; general public; (?:gnu )?general public licen[cs]e
gpl; 0.6; gnu gpl; gnu gpl
apache; 0.8; apache; apache(?: software)? licen[cs]e
mit; 1.0; mit license; (?:the )?mit license
mit; 0.8; expat; (?:the )?expat license
isc; 1.0; isc license; (?:the )?isc license
x11; 0.9; x11; (?:the )?x11 license
mpl; 0.8; mozilla; mozilla public licen[cs]e
epl; 0.8; eclipse; eclipse public licen[cs]e
eupl; 0.8; european union; european union public licen[cs]e
cddl; 0.8; common development; common development and distribution licen[cs]e
artistic; 0.8; artistic; (?:the )?artistic licen[cs]e
boost; 0.8; boost; boost software licen[cs]e
bsd; 0.7; bsd; bsd(?: style| type)? licen[cs]e
zlib; 0.9; zlib; zlib(?: libpng)? licen[cs]e
unlicense; 0.9; unlicense; (?:the )?unlicense
cc0; 0.9; cc0; cc0
vim; 0.8; vim license; vim license
ruby; 0.8; ruby; (?:the )?ruby license
perl; 0.8; perl itself; under the same terms as perl itself
postgresql; 0.9; postgresql; (?:the )?postgresql licen[cs]e
ncsa; 1.0; ncsa; (?:university of illinois )?ncsa open source licen[cs]e
openssl; 0.8; openssl; openssl licen[cs]e
unicode; 0.8; unicode; unicode (?:inc )?licen[cs]e(?: agreement)?
beerware; 0.8; beerware; beerware licen[cs]e
beerware; 0.8; beer ware; beer ware licen[cs]e
ofl; 0.8; open font; (?:sil )?open font licen[cs]e
odbl; 0.8; open database; open database licen[cs]e
odc-by; 0.8; open data commons; open data commons attribution licen[cs]e
ogl; 0.9; open government; open government licen[cs]e
etalab; 0.9; licence ouverte; licence ouverte(?: open licence)?
dl-de; 0.9; datenlizenz; datenlizenz deutschland(?: namensnennung| zero)?
php; 0.8; php license; php license
commons-clause; 0.8; commons clause; commons clause
bsl; 0.8; business source; business source licen[cs]e
openrail; 0.7; open rail; (?:responsible ai|open rail) licen[cs]e
cc-by-nc-sa; 0.9; cc by; cc by nc sa
cc-by-nc-nd; 0.9; cc by; cc by nc nd
cc-by-nc; 0.9; cc by; cc by nc
cc-by-sa; 0.9; cc by; cc by sa
cc-by-nd; 0.9; cc by; cc by nd
cc-by; 0.8; cc by; cc by
cc-by-nc-sa; 0.9; creative commons; creative commons attribution non ?commercial share ?alike
cc-by-nc-nd; 0.9; creative commons; creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc; 0.9; creative commons; creative commons attribution non ?commercial
cc-by-sa; 0.9; creative commons; creative commons attribution share ?alike
cc-by-nd; 0.9; creative commons; creative commons attribution no ?deriv(?:ative)?s
cc-by; 0.8; creative commons; creative commons attribution
cc; 0.6; creative commons; creative commons(?: public)? licen[cs]e
public-domain; 0.9; public domain; (?:dedicated to|placed in|released (?:in|in ?to)|donated to|in) the public domain
public-domain; 0.6; public domain; public domain (?:work|image|photograph|text|mark|dedication)
"""
#: Reservations and notices that name no license.
NOTICES = r"""
proprietary; 0.9; confidential; proprietary and confidential|confidential and proprietary
proprietary; 0.8; unauthorized; unauthorized (?:copying|use|reproduction|distribution|duplication)(?: or (?:copying|use|reproduction|distribution|duplication))?(?: of this (?:file|work|document|material|publication))?(?: is| via any medium is)? (?:strictly )?prohibited
proprietary; 0.8; unauthorised; unauthorised (?:copying|use|reproduction|distribution|duplication)(?: or (?:copying|use|reproduction|distribution|duplication))?(?: of this (?:file|work|document|material|publication))?(?: is| via any medium is)? (?:strictly )?prohibited
proprietary; 0.8; no part of this; no part of this (?:publication|book|work|document) may be reproduced
proprietary; 0.7; without permission; (?:may not|must not) be (?:copied|reproduced|republished|redistributed|used)(?: or (?:copied|reproduced|republished|redistributed|used))? without (?:prior |express |written |prior written )?permission
proprietary; 0.7; end user license; end user licen[cs]e agreement
proprietary; 0.6; trade secret; trade secrets? (?:of|and confidential)
no-commercial; 0.7; commercial use; (?:for )?non ?commercial use only|no commercial use|not for commercial use|commercial use (?:is )?(?:strictly )?prohibited
no-derivatives; 0.6; no modifications; no modifications (?:are )?(?:permitted|allowed)
no-derivatives; 0.6; no derivatives; no derivatives (?:are )?(?:permitted|allowed)
research-only; 0.7; research; (?:for )?(?:academic |non commercial )?research (?:purposes|use) only
personal-use; 0.6; personal use; (?:for )?personal(?: and non commercial)? use only
no-tdm; 0.8; text and data mining; (?:reserved|prohibited|opt out|rights reserved)(?: [a-z]+){0,4} text and data mining
no-training; 0.8; to train; may not be used to train(?: [a-z]+){0,3}? (?:models?|ai|artificial intelligence)
no-training; 0.8; for training; may not be used for training(?: of)?(?: [a-z]+){0,3}? (?:models?|ai|artificial intelligence)
reserved; 0.5; all rights; all rights (?:are )?reserved
some-reserved; 0.5; some rights; some rights reserved
no-rights; 0.6; no rights; no rights reserved
attribution; 0.4; attribution; (?:with|requires|provided) (?:proper |appropriate )?attribution
share-alike; 0.4; same license; under the same license
share-alike; 0.4; same terms; under the same terms(?: and conditions)?
no-warranty; 0.4; without warranty; without warranty of any kind(?: express(?:ed)? or implied)?
no-warranty; 0.4; without warranties; without warranties (?:or conditions )?of any kind(?: either)?(?: express(?:ed)? or implied)?
no-warranty; 0.3; without any warranty; without any warranty(?: without even the implied warranty of merchantability)?
no-warranty; 0.3; as is; (?:is |are )?provided (?:by the (?:author|copyright holders?)(?: and contributors)? )?as is
permission; 0.3; permission; (?:used|reprinted|reproduced|republished) (?:with|by)(?: kind)? permission
copyright; 0.4; copyright; copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright; 0.3; copyright; copyright (?:notice|holders?|owners?)
trademark; 0.2; trademark of; (?:registered )?trademark of
trademark; 0.2; trademarks of; (?:registered )?trademarks of
notice; 0.2; licensed under; licensed under(?: the)?(?: terms of)?(?: the)?
notice; 0.2; released under; released under(?: the)?(?: terms of)?(?: the)?
notice; 0.2; distributed under; distributed under(?: the)?(?: terms of)?(?: the)?
notice; 0.2; available under; available under(?: the)?(?: terms of)?(?: the)?
notice; 0.2; published under; published under(?: the)?(?: terms of)?(?: the)?
notice; 0.2; provided under; provided under(?: the)?(?: terms of)?(?: the)?
notice; 0.2; governed by; governed by the (?:following )?(?:license|terms)
license-file; 0.2; see the; see the (?:accompanying )?(?:license|copying|notice)(?: file)?
license-file; 0.2; license; (?:found|included) in the license(?: file)?(?: in the root directory)?
spdx; 0.5; spdx license identifier; spdx license identifier(?: [a-z0-9]+){1,4}
"""


def _section(lines: str) -> list[tuple[str, str, str, float]]:
    out = []
    for line in lines.strip().splitlines():
        label, weight, keyword, pattern = line.split("; ", 3)
        out.append((label, keyword, pattern, float(weight)))
    return out


def _words(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def _spdx() -> list[tuple[str, str, str, float]]:
    """One rule an identifier, also behind 'or' and 'and' in an expression; longer identifiers first."""
    names = sorted(SPDX.split(), key=lambda n: (-len(_words(n).split()), n))
    lead = r"spdx license identifier (?:(?:[a-z0-9]+ ){1,12}?(?:or|and|with) )?"
    return [(n.lower(), "spdx license identifier", rf"{lead}({_words(n)}(?: only| or later)?)", 1.0) for n in names]


def rules() -> list[Rule]:
    """All rules; a rule's priority is its place."""
    cc = [(label.replace("V", v), keyword, pattern.replace("V", _words(v)), weight) for label, keyword, pattern, weight in _section(CC_VERSIONED) for v in CC_VERSIONS]
    found = [*_spdx(), *_section(TEXTS), *_section(VERSIONS), *cc, *_section(NAMES), *_section(NOTICES)]
    return [Rule(label, keyword, rf"(?<![^ ])(?:{pattern})(?![^ ])", k, weight) for k, (label, keyword, pattern, weight) in enumerate(found)]
