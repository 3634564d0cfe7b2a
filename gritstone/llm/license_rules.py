"""Ordered signature rules for license texts, written against normalised words joined by single spaces.

Each line is ``label | keyword | score | regex``. The keyword is one whole word that any match contains or starts with,
and gates the regex; earlier lines win ties. Patterns see the text lower-cased with every run of separators turned into
one space, so ``2.0`` reads ``2 0``.
"""

from __future__ import annotations

SIGNATURES = r"""
mit | mit | 1.0 | released under the mit license
mit | mit | 1.0 | licensed under the (?:terms of the )?mit license
mit | mit | 1.0 | distributed under the (?:terms of the )?mit license
mit | mit | 0.95 | available under the (?:terms of the )?mit license
mit | mit | 0.95 | spdx license identifier mit
mit | opensource | 0.95 | opensource org licenses mit
mit | permission | 0.98 | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | whom | 0.9 | to permit persons to whom the software is furnished to do so
mit | mit | 0.9 | the mit license mit
mit | mit | 0.8 | mit licen[cs]ed?
mit | expat | 0.8 | expat licen[cs]e
mit-0 | mit | 0.95 | mit no attribution
mit-0 | mit | 0.95 | spdx license identifier mit 0
x11 | x11 | 0.9 | x11 licen[cs]e
x11 | mit | 0.9 | mit x11 licen[cs]e
apache-2.0 | apache | 1.0 | licensed under the apache licen[cs]e version 2 0
apache-2.0 | apache | 1.0 | apache licen[cs]e version 2 0
apache-2.0 | apache | 1.0 | apache licen[cs]e 2 0
apache-2.0 | apache | 0.95 | apache license v ?2(?: 0)?
apache-2.0 | apache | 0.95 | spdx license identifier apache 2 0
apache-2.0 | apache | 0.95 | apache org licenses license 2 0
apache-2.0 | apache | 0.9 | apache software license version 2(?: 0)?
apache-2.0 | compliance | 0.9 | you may not use this file except in compliance with the license
apache-1.1 | apache | 0.95 | apache (?:software )?license version 1 1
apache-1.1 | apache | 0.95 | spdx license identifier apache 1 1
apache-1.0 | apache | 0.95 | apache (?:software )?license version 1 0
apache | apache | 0.7 | apache (?:software )?licen[cs]e
gpl-3.0 | gnu | 1.0 | licensed under the gnu general public license version 3
gpl-3.0 | gnu | 1.0 | gnu general public licen[cs]e version 3
gpl-3.0 | gnu | 1.0 | gnu general public licen[cs]e v ?3
gpl-3.0 | version | 0.9 | general public license as published by the free software foundation either version 3
gpl-3.0 | gnu | 0.95 | gnu gpl v ?3
gpl-3.0 | gplv3 | 0.95 | gplv3
gpl-3.0 | gpl | 0.9 | gpl (?:version |v )?3(?: 0)?
gpl-3.0-only | gpl | 0.98 | spdx license identifier gpl 3 0 only
gpl-3.0-or-later | gpl | 0.98 | spdx license identifier gpl 3 0 or later
gpl-3.0-or-later | version | 0.95 | version 3 of the license or at your option any later version
gpl-2.0 | gnu | 1.0 | licensed under the gnu general public license version 2
gpl-2.0 | gnu | 1.0 | gnu general public licen[cs]e version 2
gpl-2.0 | gnu | 1.0 | gnu general public licen[cs]e v ?2
gpl-2.0 | gnu | 0.95 | gnu gpl v ?2
gpl-2.0 | gplv2 | 0.95 | gplv2
gpl-2.0 | gpl | 0.9 | gpl (?:version |v )?2(?: 0)?
gpl-2.0-only | gpl | 0.98 | spdx license identifier gpl 2 0 only
gpl-2.0-or-later | gpl | 0.98 | spdx license identifier gpl 2 0 or later
gpl-2.0-or-later | version | 0.95 | version 2 of the license or at your option any later version
gpl-1.0 | gnu | 0.9 | gnu general public licen[cs]e version 1
gpl | gnu | 0.8 | gnu general public licen[cs]e
gpl | gpl | 0.6 | gpl licen[cs]ed?
lgpl-3.0 | lesser | 1.0 | gnu lesser general public licen[cs]e version 3
lgpl-3.0 | lgplv3 | 0.95 | lgplv3
lgpl-3.0 | lgpl | 0.9 | lgpl (?:version |v )?3(?: 0)?
lgpl-3.0-only | lgpl | 0.98 | spdx license identifier lgpl 3 0 only
lgpl-3.0-or-later | lgpl | 0.98 | spdx license identifier lgpl 3 0 or later
lgpl-2.1 | lesser | 1.0 | gnu lesser general public licen[cs]e version 2 1
lgpl-2.1 | lgplv2 | 0.95 | lgplv2 1
lgpl-2.1 | lgpl | 0.9 | lgpl (?:version |v )?2 1
lgpl-2.1-only | lgpl | 0.98 | spdx license identifier lgpl 2 1 only
lgpl-2.1-or-later | lgpl | 0.98 | spdx license identifier lgpl 2 1 or later
lgpl-2.0 | library | 0.95 | gnu library general public licen[cs]e version 2
lgpl-2.0 | library | 0.8 | gnu library general public licen[cs]e
lgpl | lesser | 0.8 | gnu lesser general public licen[cs]e
lgpl | lgpl | 0.6 | lgpl licen[cs]ed?
agpl-3.0 | affero | 1.0 | gnu affero general public licen[cs]e version 3
agpl-3.0 | agplv3 | 0.95 | agplv3
agpl-3.0 | agpl | 0.9 | agpl (?:version |v )?3(?: 0)?
agpl-3.0-only | agpl | 0.98 | spdx license identifier agpl 3 0 only
agpl-3.0-or-later | agpl | 0.98 | spdx license identifier agpl 3 0 or later
agpl | affero | 0.8 | (?:gnu )?affero general public licen[cs]e
gfdl-1.3 | documentation | 0.95 | gnu free documentation licen[cs]e version 1 3
gfdl-1.2 | documentation | 0.95 | gnu free documentation licen[cs]e version 1 2
gfdl-1.1 | documentation | 0.95 | gnu free documentation licen[cs]e version 1 1
gfdl | documentation | 0.8 | gnu free documentation licen[cs]e
gfdl | gfdl | 0.7 | gfdl licen[cs]ed?
bsd-3-clause | bsd | 1.0 | bsd 3 clause
bsd-3-clause | bsd | 1.0 | 3 clause bsd
bsd-3-clause | bsd | 0.95 | three clause bsd
bsd-3-clause | bsd | 0.95 | (?:new|modified|revised) bsd licen[cs]e
bsd-3-clause | neither | 0.9 | neither the name of [a-z0-9 ]{1,60} nor the names of its contributors may be used to endorse
bsd-3-clause-clear | bsd | 0.95 | bsd 3 clause clear
bsd-2-clause | bsd | 1.0 | bsd 2 clause
bsd-2-clause | bsd | 1.0 | 2 clause bsd
bsd-2-clause | bsd | 0.95 | two clause bsd
bsd-2-clause | bsd | 0.95 | (?:simplified|freebsd) bsd licen[cs]e
bsd-2-clause | freebsd | 0.9 | freebsd licen[cs]e
bsd-2-clause-patent | bsd | 0.95 | bsd 2 clause patent
bsd-4-clause | bsd | 0.95 | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd licen[cs]e)
bsd-4-clause | advertising | 0.8 | all advertising materials mentioning features or use of this software
0bsd | 0bsd | 0.95 | 0bsd
0bsd | zero | 0.95 | zero clause bsd
bsd | redistribution | 0.8 | redistribution and use in source and binary forms with or without modification are permitted
bsd | bsd | 0.7 | bsd (?:style )?licen[cs]ed?
isc | isc | 0.95 | spdx license identifier isc
isc | isc | 0.9 | isc licen[cs]ed?
isc | permission | 0.9 | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
mpl-2.0 | mozilla | 1.0 | mozilla public licen[cs]e (?:version |v )?2 0
mpl-2.0 | mpl | 0.95 | mpl (?:version |v )?2 0
mpl-2.0 | mozilla | 0.9 | mozilla org mpl 2 0
mpl-1.1 | mozilla | 1.0 | mozilla public licen[cs]e (?:version |v )?1 1
mpl-1.1 | mpl | 0.95 | mpl (?:version |v )?1 1
mpl-1.0 | mozilla | 0.95 | mozilla public licen[cs]e (?:version |v )?1 0
mpl | mozilla | 0.8 | mozilla public licen[cs]e
epl-2.0 | eclipse | 1.0 | eclipse public licen[cs]e (?:version |v )?2 0
epl-2.0 | epl | 0.95 | epl (?:version |v )?2 0
epl-1.0 | eclipse | 1.0 | eclipse public licen[cs]e (?:version |v )?1 0
epl-1.0 | epl | 0.95 | epl (?:version |v )?1 0
epl | eclipse | 0.8 | eclipse public licen[cs]e
edl-1.0 | eclipse | 0.95 | eclipse distribution licen[cs]e (?:version |v )?1 0
cddl-1.1 | cddl | 0.95 | cddl (?:version |v )?1 1
cddl-1.0 | cddl | 0.95 | cddl (?:version |v )?1 0
cddl-1.1 | distribution | 0.95 | common development and distribution licen[cs]e (?:version |v )?1 1
cddl-1.0 | distribution | 0.95 | common development and distribution licen[cs]e (?:version |v )?1 0
cddl | distribution | 0.8 | common development and distribution licen[cs]e
cpl-1.0 | common | 0.95 | common public licen[cs]e (?:version |v )?1 0
cpal-1.0 | attribution | 0.95 | common public attribution licen[cs]e
ipl-1.0 | ibm | 0.95 | ibm public licen[cs]e
eupl-1.2 | eupl | 0.95 | eupl (?:version |v )?1 2
eupl-1.1 | eupl | 0.95 | eupl (?:version |v )?1 1
eupl-1.2 | european | 0.95 | european union public licen[cs]e (?:version |v )?1 2
eupl-1.1 | european | 0.95 | european union public licen[cs]e (?:version |v )?1 1
eupl | european | 0.8 | european union public licen[cs]e
artistic-2.0 | artistic | 0.95 | artistic licen[cs]e (?:version |v )?2 0
artistic-1.0 | artistic | 0.95 | artistic licen[cs]e (?:version |v )?1 0
artistic | artistic | 0.7 | artistic licen[cs]e
bsl-1.0 | boost | 0.95 | boost software licen[cs]e(?: version 1 0)?
busl-1.1 | business | 0.95 | business source licen[cs]e(?: version)? 1 1
busl | business | 0.8 | business source licen[cs]e
sspl-1.0 | server | 0.95 | server side public licen[cs]e
sspl-1.0 | sspl | 0.9 | sspl (?:version |v )?1
elastic-2.0 | elastic | 0.95 | elastic licen[cs]e (?:version |v )?2(?: 0)?
elastic | elastic | 0.7 | elastic licen[cs]e
commons-clause | commons | 0.9 | commons clause licen[cs]e condition
prosperity | prosperity | 0.9 | prosperity public licen[cs]e
polyform-noncommercial | polyform | 0.95 | polyform noncommercial licen[cs]e
polyform-small-business | polyform | 0.95 | polyform small business licen[cs]e
polyform-shield | polyform | 0.95 | polyform shield licen[cs]e
unlicense | unlicense | 0.9 | the unlicense
unlicense | unlicense | 0.9 | unlicense org
unlicense | unencumbered | 0.95 | free and unencumbered software released into the public domain
wtfpl | wtfpl | 0.9 | wtfpl
wtfpl | what | 0.9 | do what the fuck you want to public licen[cs]e
zlib | zlib | 0.9 | zlib (?:libpng )?licen[cs]ed?
zlib | misrepresented | 0.9 | the origin of this software must not be misrepresented
libpng | libpng | 0.8 | libpng licen[cs]e
python-2.0 | python | 0.9 | python software foundation licen[cs]e(?: version 2)?
python-2.0 | psf | 0.9 | psf licen[cs]e
php-3.01 | php | 0.95 | php licen[cs]e (?:version |v )?3 01
php-3.0 | php | 0.95 | php licen[cs]e (?:version |v )?3 0
ruby | ruby | 0.8 | ruby licen[cs]e
perl | perl | 0.8 | same terms as perl itself
postgresql | postgresql | 0.9 | postgresql licen[cs]e
openssl | openssl | 0.9 | openssl (?:and ssleay )?licen[cs]e
curl | curl | 0.8 | curl licen[cs]e
ntp | ntp | 0.8 | ntp licen[cs]e
afl-3.0 | academic | 0.95 | academic free licen[cs]e (?:version |v )?3 0
afl-2.1 | academic | 0.95 | academic free licen[cs]e (?:version |v )?2 1
ecl-2.0 | educational | 0.95 | educational community licen[cs]e (?:version |v )?2 0
osl-3.0 | open | 0.95 | open software licen[cs]e (?:version |v )?3 0
ncsa | illinois | 0.9 | university of illinois(?: ncsa)? open source licen[cs]e
ofl-1.1 | font | 0.95 | sil open font licen[cs]e(?: version 1 1)?
ofl-1.1 | ofl | 0.9 | ofl (?:version |v )?1 1
ms-pl | microsoft | 0.95 | microsoft public licen[cs]e
ms-rl | microsoft | 0.95 | microsoft reciprocal licen[cs]e
apsl-2.0 | apple | 0.95 | apple public source licen[cs]e(?: version 2 0)?
qpl-1.0 | q | 0.8 | q public licen[cs]e
npl-1.1 | netscape | 0.9 | netscape public licen[cs]e
spl-1.0 | sun | 0.9 | sun public licen[cs]e
sissl | sun | 0.9 | sun industry standards source licen[cs]e
watcom-1.0 | watcom | 0.9 | sybase open watcom public licen[cs]e
vim | vim | 0.8 | vim licen[cs]e
beerware | beerware | 0.9 | beerware(?: licen[cs]e)?
json | json | 0.8 | json licen[cs]e
json | evil | 0.95 | the software shall be used for good not evil
upl-1.0 | universal | 0.95 | universal permissive licen[cs]e
blueoak-1.0.0 | blue | 0.95 | blue oak model licen[cs]e
mulan-2.0 | mulan | 0.95 | mulan (?:psl|permissive software licen[cs]e) ?v? ?2
cecill-2.1 | cecill | 0.95 | cecill (?:version |v )?2 1
cecill-b | cecill | 0.95 | cecill b
cecill-c | cecill | 0.95 | cecill c
cecill | cecill | 0.8 | cecill(?: free software)?(?: licen[cs]e)?
odbl-1.0 | database | 0.95 | open database licen[cs]e
odc-by-1.0 | commons | 0.95 | open data commons attribution licen[cs]e
pddl-1.0 | dedication | 0.95 | public domain dedication and licen[cs]e
cdla-permissive-2.0 | community | 0.95 | community data licen[cs]e agreement permissive(?: version)? 2 0
cdla-permissive-1.0 | community | 0.9 | community data licen[cs]e agreement permissive
cdla-sharing-1.0 | community | 0.9 | community data licen[cs]e agreement sharing
ogl-uk-3.0 | government | 0.95 | open government licen[cs]e(?: v ?3 0| v3 0)?
openrail-m | openrail | 0.9 | (?:creativeml |bigscience )?openrail m
openrail-m | rail | 0.9 | open rail m
openrail | responsible | 0.8 | responsible ai licen[cs]e
llama-2 | llama | 0.9 | llama 2 community licen[cs]e
llama-3 | llama | 0.9 | llama 3 community licen[cs]e
gemma | gemma | 0.8 | gemma terms of use
cc0-1.0 | cc0 | 1.0 | cc0 1 0(?: universal)?
cc0-1.0 | cc0 | 0.9 | cc0
cc0-1.0 | publicdomain | 0.95 | creativecommons org publicdomain zero 1 0
cc0-1.0 | creative | 0.95 | creative commons zero
cc-by-nc-nd-4.0 | cc | 1.0 | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc | 1.0 | cc by nc nd 3 0
cc-by-nc-sa-4.0 | cc | 1.0 | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc | 1.0 | cc by nc sa 3 0
cc-by-nc-sa-2.0 | cc | 1.0 | cc by nc sa 2 0
cc-by-nc-4.0 | cc | 1.0 | licensed under cc by nc 4 0
cc-by-nc-4.0 | cc | 1.0 | cc by nc 4 0
cc-by-nc-3.0 | cc | 1.0 | cc by nc 3 0
cc-by-nc-2.0 | cc | 1.0 | cc by nc 2 0
cc-by-nd-4.0 | cc | 1.0 | cc by nd 4 0
cc-by-nd-3.0 | cc | 1.0 | cc by nd 3 0
cc-by-sa-4.0 | cc | 1.0 | cc by sa 4 0
cc-by-sa-3.0 | cc | 1.0 | cc by sa 3 0
cc-by-sa-2.5 | cc | 1.0 | cc by sa 2 5
cc-by-sa-2.0 | cc | 1.0 | cc by sa 2 0
cc-by-4.0 | cc | 1.0 | cc by 4 0
cc-by-3.0 | cc | 1.0 | cc by 3 0
cc-by-2.0 | cc | 1.0 | cc by 2 0
cc-by-nc-nd | cc | 0.8 | cc by nc nd
cc-by-nc-sa | cc | 0.8 | cc by nc sa
cc-by-nc | cc | 0.8 | cc by nc
cc-by-nd | cc | 0.8 | cc by nd
cc-by-sa | cc | 0.8 | cc by sa
cc-by | cc | 0.6 | (?:licensed under|license) cc by
cc-by-nc-nd-4.0 | creativecommons | 0.95 | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-4.0 | creativecommons | 0.95 | creativecommons org licenses by nc sa 4 0
cc-by-nc-4.0 | creativecommons | 0.95 | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | creativecommons | 0.95 | creativecommons org licenses by nd 4 0
cc-by-sa-4.0 | creativecommons | 0.95 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons | 0.95 | creativecommons org licenses by sa 3 0
cc-by-4.0 | creativecommons | 0.95 | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons | 0.95 | creativecommons org licenses by 3 0
cc-by-nc-nd-4.0 | creative | 0.95 | creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0
cc-by-nc-sa-4.0 | creative | 0.95 | creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-4.0 | creative | 0.95 | creative commons attribution non ?commercial 4 0
cc-by-sa-4.0 | creative | 0.95 | creative commons attribution share ?alike 4 0
cc-by-sa-3.0 | creative | 0.95 | creative commons attribution share ?alike 3 0
cc-by-nd-4.0 | creative | 0.95 | creative commons attribution no ?deriv(?:ative)?s? 4 0
cc-by-4.0 | creative | 0.95 | creative commons attribution 4 0
cc-by-3.0 | creative | 0.95 | creative commons attribution 3 0
cc-by-nc | creative | 0.8 | creative commons attribution non ?commercial
cc-by-sa | creative | 0.8 | creative commons attribution share ?alike
cc-by | creative | 0.7 | creative commons attribution(?: licen[cs]e)?
cc | creative | 0.5 | creative commons licen[cs]e
public-domain | domain | 0.8 | (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain | domain | 0.6 | public domain (?:work|dedication|mark)
proprietary | proprietary | 0.8 | proprietary and confidential
proprietary | rights | 0.5 | all rights reserved
proprietary | unauthorized | 0.8 | unauthorized (?:copying|reproduction|distribution) [a-z0-9 ]{0,40}(?:is )?(?:strictly )?prohibited
proprietary | commercial | 0.7 | commercial licen[cs]e agreement
proprietary | end | 0.8 | end user licen[cs]e agreement
"""


def signatures() -> list[tuple[str, str, float, str]]:
    """(label, keyword, score, regex) in order of priority."""
    rows = [tuple(x.strip() for x in line.split(" | ", 3)) for line in SIGNATURES.strip().splitlines()]
    return [(label, word, float(score), regex) for label, word, score, regex in rows]
