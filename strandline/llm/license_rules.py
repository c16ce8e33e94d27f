"""Signature rules of the license scan, written by hand.

One rule a line: priority, label, keyword, then the pattern: a regular
expression over normalised words (lower case, one space between words, no
punctuation: "2.0" is the two words "2 0").  The keyword is a word that every
match holds; a text without it never meets the pattern.  Priorities: 30 a bare
name, 40 a name that is explicit, 50 a grant in words, 60 a name with a version,
70 a version "or later", 80 the sentences of a license's own text, 90 an SPDX
tag.  The order of lines breaks ties.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

RULES = r"""
30 gpl gpl: (?:gnu )?gpl
40 gpl general: (?:the )?gnu general public licen[cs]e
40 gpl general: gnu general public licen[cs]e gpl
50 gpl gpl: (?:licensed|released|distributed|available|provided|covered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
50 gpl general: (?:licensed|released|distributed|available|provided|covered) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e
60 gpl-1 gpl: (?:gnu )?gpl (?:version |v ?)?1(?: 0)?
60 gpl-2 gpl: (?:gnu )?gpl (?:version |v ?)?2(?: 0)?
60 gpl-2 gplv2: (?:gnu )?gplv2
60 gpl-2 gpl2: (?:gnu )?gpl2
60 gpl-3 gpl: (?:gnu )?gpl (?:version |v ?)?3(?: 0)?
60 gpl-3 gplv3: (?:gnu )?gplv3
60 gpl-3 gpl3: (?:gnu )?gpl3
60 gpl-1 general: gnu general public licen[cs]e (?:version |v ?)?1(?: 0)?
60 gpl-2 general: gnu general public licen[cs]e (?:version |v ?)?2(?: 0)?
60 gpl-3 general: gnu general public licen[cs]e (?:version |v ?)?3(?: 0)?
60 gpl-2 general: version 2(?: 0)? of the (?:gnu )?general public licen[cs]e
60 gpl-3 general: version 3(?: 0)? of the (?:gnu )?general public licen[cs]e
70 gpl-2-or-later gpl: (?:gnu )?gpl (?:version |v ?)?2(?: 0)? or (?:any )?later
70 gpl-3-or-later gpl: (?:gnu )?gpl (?:version |v ?)?3(?: 0)? or (?:any )?later
70 gpl-2-or-later gplv2: (?:gnu )?gplv2 or (?:any )?later
70 gpl-3-or-later gplv3: (?:gnu )?gplv3 or (?:any )?later
70 gpl-2-or-later general: gnu general public licen[cs]e (?:version |v ?)?2(?: 0)? or (?:any )?later
70 gpl-3-or-later general: gnu general public licen[cs]e (?:version |v ?)?3(?: 0)? or (?:any )?later
70 gpl-2-or-later foundation: either version 2 of the licen[cs]e or at your option any later version published by the free software foundation
70 gpl-2-or-later option: either version 2 of the licen[cs]e or at your option any later version
70 gpl-3-or-later option: either version 3 of the licen[cs]e or at your option any later version
80 gpl general: under the terms of the gnu general public licen[cs]e as published by the free software foundation
80 gpl general: under the terms of the gnu general public licen[cs]e
80 gpl general: you should have received a copy of the gnu general public licen[cs]e along with this program
80 gpl general: see the gnu general public licen[cs]e for more details
80 gpl gnu: (?:http |https )?www gnu org licenses gpl(?: [0-9]+ [0-9]+)?(?: html| txt)?
80 gpl gnu: (?:http |https )?www gnu org copyleft gpl(?: html)?
80 gpl freedom: the licenses for most software are designed to take away your freedom to share and change it
90 gpl-1 spdx: spdx license identifier gpl 1 0(?: only)?
90 gpl-2 spdx: spdx license identifier gpl 2 0(?: only)?
90 gpl-3 spdx: spdx license identifier gpl 3 0(?: only)?
90 gpl-2-or-later spdx: spdx license identifier gpl 2 0 or later
90 gpl-3-or-later spdx: spdx license identifier gpl 3 0 or later
30 lgpl lgpl: (?:gnu )?lgpl
40 lgpl lesser: (?:the )?gnu lesser general public licen[cs]e
40 lgpl library: (?:the )?gnu library general public licen[cs]e
50 lgpl lgpl: (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl
50 lgpl lesser: (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu lesser general public licen[cs]e
60 lgpl-2 lgpl: (?:gnu )?lgpl (?:version |v ?)?2(?: 0)?
60 lgpl-2.1 lgpl: (?:gnu )?lgpl (?:version |v ?)?2 1
60 lgpl-3 lgpl: (?:gnu )?lgpl (?:version |v ?)?3(?: 0)?
60 lgpl-3 lgplv3: (?:gnu )?lgplv3
60 lgpl-2.1 lesser: gnu lesser general public licen[cs]e (?:version |v ?)?2 1
60 lgpl-3 lesser: gnu lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?
60 lgpl-2 library: gnu library general public licen[cs]e (?:version |v ?)?2(?: 0)?
70 lgpl-2.1-or-later lgpl: (?:gnu )?lgpl (?:version |v ?)?2 1 or (?:any )?later
70 lgpl-3-or-later lgpl: (?:gnu )?lgpl (?:version |v ?)?3(?: 0)? or (?:any )?later
70 lgpl-2.1-or-later lesser: gnu lesser general public licen[cs]e (?:version |v ?)?2 1 or (?:any )?later
80 lgpl lesser: under the terms of the gnu lesser general public licen[cs]e
80 lgpl library: under the terms of the gnu library general public licen[cs]e
80 lgpl lesser: you should have received a copy of the gnu lesser general public licen[cs]e
80 lgpl gnu: (?:http |https )?www gnu org licenses lgpl(?: [0-9]+ [0-9]+)?(?: html| txt)?
90 lgpl-2 spdx: spdx license identifier lgpl 2 0(?: only)?
90 lgpl-2.1 spdx: spdx license identifier lgpl 2 1(?: only)?
90 lgpl-3 spdx: spdx license identifier lgpl 3 0(?: only)?
90 lgpl-2.1-or-later spdx: spdx license identifier lgpl 2 1 or later
90 lgpl-3-or-later spdx: spdx license identifier lgpl 3 0 or later
30 agpl agpl: (?:gnu )?agpl
40 agpl affero: (?:the )?(?:gnu )?affero general public licen[cs]e
50 agpl agpl: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl
60 agpl-1 affero: affero general public licen[cs]e (?:version |v ?)?1(?: 0)?
60 agpl-3 agpl: (?:gnu )?agpl (?:version |v ?)?3(?: 0)?
60 agpl-3 agplv3: (?:gnu )?agplv3
60 agpl-3 affero: (?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?
70 agpl-3-or-later affero: (?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)? or (?:any )?later
80 agpl affero: under the terms of the gnu affero general public licen[cs]e
80 agpl affero: you should have received a copy of the gnu affero general public licen[cs]e
80 agpl gnu: (?:http |https )?www gnu org licenses agpl(?: [0-9]+ [0-9]+)?(?: html| txt)?
90 agpl-3 spdx: spdx license identifier agpl 3 0(?: only)?
90 agpl-3-or-later spdx: spdx license identifier agpl 3 0 or later
40 gfdl gfdl: (?:gnu )?gfdl
40 gfdl documentation: (?:the )?gnu free documentation licen[cs]e
60 gfdl-1.1 documentation: gnu free documentation licen[cs]e (?:version |v ?)?1 1
60 gfdl-1.2 documentation: gnu free documentation licen[cs]e (?:version |v ?)?1 2
60 gfdl-1.3 documentation: gnu free documentation licen[cs]e (?:version |v ?)?1 3
80 gfdl invariant: with no invariant sections no front cover texts and no back cover texts
80 gfdl documentation: copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
90 gfdl-1.3 spdx: spdx license identifier gfdl 1 3(?: only| or later)?
30 apache apache: apache licen[cs]ed?
40 apache apache: apache software licen[cs]e
50 apache apache: (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[cs]e)?
60 apache-1 apache: apache(?: software)? licen[cs]e (?:version |v ?)?1(?: 0)?
60 apache-1.1 apache: apache(?: software)? licen[cs]e (?:version |v ?)?1 1
60 apache-2 apache: apache(?: software)? licen[cs]e (?:version |v ?)?2(?: 0)?
60 apache-2 apache: apache 2(?: 0)?(?: licen[cs]ed?)?
60 apache-2 asl: asl 2(?: 0)?
60 apache-2 apache: version 2 0 of the apache licen[cs]e
80 apache-2 apache: licensed under the apache licen[cs]e version 2 0 the licen[cs]e
80 apache compliance: you may not use this file except in compliance with the licen[cs]e
80 apache obtain: you may obtain a copy of the licen[cs]e at
80 apache-2 apache: (?:http |https )?www apache org licenses license 2 0(?: html| txt)?
80 apache basis: distributed under the licen[cs]e is distributed on an as is basis
80 apache governing: see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e
80 apache-1.1 apache: this product includes software developed by the apache software foundation
90 apache-1 spdx: spdx license identifier apache 1 0
90 apache-1.1 spdx: spdx license identifier apache 1 1
90 apache-2 spdx: spdx license identifier apache 2 0
30 mit mit: mit licen[cs]ed?
40 mit expat: expat licen[cs]e
40 mit x11: (?:mit )?x11 licen[cs]e
50 mit mit: (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?
50 mit mit: (?:license|licence) mit
60 mit mit: the mit licen[cs]e mit
60 mit-0 mit: mit no attribution
80 mit hereby: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
80 mit hereby: permission is hereby granted free of charge to any person obtaining a copy
80 mit sublicense: to use copy modify merge publish distribute sublicense and or sell copies of the software
80 mit substantial: shall be included in all copies or substantial portions of the software
80 mit opensource: (?:http |https )?(?:www )?opensource org licenses mit(?: license)?(?: php)?
80 mit noninfringement: warranties of merchantability fitness for a particular purpose and noninfringement
90 mit spdx: spdx license identifier mit
90 mit-0 spdx: spdx license identifier mit 0
30 isc isc: isc licen[cs]e
50 isc isc: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc(?: licen[cs]e)?
80 isc hereby: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
80 isc permission: permission to use copy modify and(?: or)? distribute this software for any purpose
90 isc spdx: spdx license identifier isc
30 bsd bsd: bsd(?: style)? licen[cs]ed?
40 bsd berkeley: berkeley software distribution licen[cs]e
50 bsd bsd: (?:licensed|released|distributed|available|provided) under (?:the |a )?(?:terms of (?:the |a )?)?bsd(?: style)?(?: licen[cs]e)?
60 bsd-2-clause bsd: bsd 2 clause(?: licen[cs]e)?
60 bsd-2-clause bsd: 2 clause bsd(?: licen[cs]e)?
60 bsd-2-clause bsd: two clause bsd(?: licen[cs]e)?
60 bsd-2-clause simplified: simplified bsd(?: licen[cs]e)?
60 bsd-2-clause freebsd: freebsd licen[cs]e
60 bsd-3-clause bsd: bsd 3 clause(?: licen[cs]e)?
60 bsd-3-clause bsd: 3 clause bsd(?: licen[cs]e)?
60 bsd-3-clause bsd: three clause bsd(?: licen[cs]e)?
60 bsd-3-clause bsd: (?:new|modified|revised) bsd(?: licen[cs]e)?
60 bsd-4-clause bsd: bsd 4 clause(?: licen[cs]e)?
60 bsd-4-clause bsd: 4 clause bsd(?: licen[cs]e)?
60 bsd-4-clause original: original bsd(?: licen[cs]e)?
60 0bsd 0bsd: 0bsd(?: licen[cs]e)?
60 0bsd bsd: bsd zero clause licen[cs]e
80 bsd redistribution: redistribution and use in source and binary forms with or without modification are permitted
80 bsd redistribution: redistribution and use in source and binary forms with or without modification
80 bsd redistributions: redistributions of source code must retain the above copyright notice
80 bsd redistributions: redistributions in binary form must reproduce the above copyright notice
80 bsd-3-clause endorse: neither the names? of .{1,80} contributors may be used to endorse or promote products
80 bsd-3-clause endorse: names? of (?:its|the copyright holders?|any) contributors may be used to endorse
80 bsd-4-clause advertising: all advertising materials mentioning features or use of this software must display
80 bsd-4-clause acknowledgement: must display the following acknowledgement
90 bsd-2-clause spdx: spdx license identifier bsd 2 clause
90 bsd-3-clause spdx: spdx license identifier bsd 3 clause
90 bsd-4-clause spdx: spdx license identifier bsd 4 clause
90 0bsd spdx: spdx license identifier 0bsd
40 mpl mozilla: mozilla public licen[cs]e
40 mpl mpl: mpl licen[cs]ed?
50 mpl mpl: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mpl
50 mpl mozilla: (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e
60 mpl-1 mozilla: mozilla public licen[cs]e (?:version |v ?)?1(?: 0)?
60 mpl-1.1 mozilla: mozilla public licen[cs]e (?:version |v ?)?1 1
60 mpl-2 mozilla: mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
60 mpl-1.1 mpl: mpl (?:version |v ?)?1 1
60 mpl-2 mpl: mpl (?:version |v ?)?2(?: 0)?
80 mpl-2 mozilla: this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
80 mpl mozilla: subject to the terms of the mozilla public licen[cs]e
80 mpl-2 mozilla: (?:http |https )?(?:www )?mozilla org mpl(?: 2 0)?
90 mpl-1.1 spdx: spdx license identifier mpl 1 1
90 mpl-2 spdx: spdx license identifier mpl 2 0
40 epl eclipse: eclipse public licen[cs]e
60 epl-1 eclipse: eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
60 epl-2 eclipse: eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
60 epl-1 epl: epl (?:version |v ?)?1(?: 0)?
60 epl-2 epl: epl (?:version |v ?)?2(?: 0)?
80 epl eclipse: (?:http |https )?www eclipse org (?:legal )?epl(?: v10| v20| 2 0)?(?: html)?
90 epl-1 spdx: spdx license identifier epl 1 0
90 epl-2 spdx: spdx license identifier epl 2 0
40 edl eclipse: eclipse distribution licen[cs]e
40 eupl eupl: eupl
40 eupl european: european union public licen[cs]e
60 eupl-1.1 eupl: eupl (?:version |v ?)?1 1
60 eupl-1.2 eupl: eupl (?:version |v ?)?1 2
60 eupl-1.2 european: european union public licen[cs]e (?:version |v ?)?1 2
90 eupl-1.2 spdx: spdx license identifier eupl 1 2
40 cddl cddl: cddl
40 cddl development: common development and distribution licen[cs]e
60 cddl-1 cddl: cddl (?:version |v ?)?1(?: 0)?
60 cddl-1.1 cddl: cddl (?:version |v ?)?1 1
90 cddl-1 spdx: spdx license identifier cddl 1 0
90 cddl-1.1 spdx: spdx license identifier cddl 1 1
40 cpl common: common public licen[cs]e
60 cpl-1 common: common public licen[cs]e (?:version |v ?)?1(?: 0)?
90 cpl-1 spdx: spdx license identifier cpl 1 0
40 osl open: open software licen[cs]e
60 osl-2.1 open: open software licen[cs]e (?:version |v ?)?2 1
60 osl-3 open: open software licen[cs]e (?:version |v ?)?3(?: 0)?
90 osl-3 spdx: spdx license identifier osl 3 0
40 afl academic: academic free licen[cs]e
60 afl-2.1 academic: academic free licen[cs]e (?:version |v ?)?2 1
60 afl-3 academic: academic free licen[cs]e (?:version |v ?)?3(?: 0)?
90 afl-3 spdx: spdx license identifier afl 3 0
40 artistic artistic: artistic licen[cs]e
60 artistic-1 artistic: artistic licen[cs]e (?:version |v ?)?1(?: 0)?
60 artistic-2 artistic: artistic licen[cs]e (?:version |v ?)?2(?: 0)?
60 artistic perl: same terms as perl(?: itself)?
90 artistic-1 spdx: spdx license identifier artistic 1 0
90 artistic-2 spdx: spdx license identifier artistic 2 0
40 boost boost: boost(?: software)? licen[cs]e
60 boost-1 boost: boost(?: software)? licen[cs]e (?:version |v ?)?1(?: 0)?
80 boost-1 boost: distributed under the boost software licen[cs]e version 1 0
80 boost-1 boost: (?:http |https )?www boost org license 1 0(?: txt)?
90 boost-1 spdx: spdx license identifier bsl 1 0
40 busl business: business source licen[cs]e
60 busl-1.1 business: business source licen[cs]e (?:version |v ?)?1 1
90 busl-1.1 spdx: spdx license identifier busl 1 1
40 zpl zope: zope public licen[cs]e
60 zpl-2.1 zope: zope public licen[cs]e (?:version |v ?)?2 1
40 lppl latex: latex project public licen[cs]e
60 lppl-1.3 latex: latex project public licen[cs]e (?:version |v ?)?1 3(?:c)?
40 lppl lppl: lppl
40 ofl ofl: (?:sil )?ofl
40 ofl font: (?:sil )?open font licen[cs]e
60 ofl-1.1 font: (?:sil )?open font licen[cs]e (?:version |v ?)?1 1
90 ofl-1.1 spdx: spdx license identifier ofl 1 1
40 ms-pl microsoft: microsoft public licen[cs]e
40 ms-rl microsoft: microsoft reciprocal licen[cs]e
90 ms-pl spdx: spdx license identifier ms pl
90 ms-rl spdx: spdx license identifier ms rl
40 psf python: python software foundation licen[cs]e
40 psf psf: psf licen[cs]e
60 psf-2 python: python software foundation licen[cs]e (?:version |v ?)?2(?: 0)?
90 psf-2 spdx: spdx license identifier (?:psf|python) 2 0
40 php php: php licen[cs]e
60 php-3.01 php: php licen[cs]e (?:version |v ?)?3 01
40 ruby ruby: ruby licen[cs]e
50 ruby ruby: same terms as ruby(?: itself)?
40 ecl educational: educational community licen[cs]e
60 ecl-2 educational: educational community licen[cs]e (?:version |v ?)?2(?: 0)?
40 cecill cecill: cecill(?: free software)?(?: licen[cs]e)?
60 cecill-2.1 cecill: cecill (?:version |v ?)?2 1
40 odbl odbl: odbl
40 odbl database: open database licen[cs]e
60 odbl-1 database: open database licen[cs]e (?:version |v ?)?1(?: 0)?
40 odc-by commons: open data commons attribution licen[cs]e
40 pddl dedication: public domain dedication and licen[cs]e
40 dbcl database: database contents licen[cs]e
40 ncsa ncsa: (?:university of illinois )?ncsa(?: open source)? licen[cs]e
90 ncsa spdx: spdx license identifier ncsa
40 wtfpl wtfpl: wtfpl
80 wtfpl fuck: do what the fuck you want to(?: public licen[cs]e)?
90 wtfpl spdx: spdx license identifier wtfpl
40 unlicense unlicense: (?:the )?unlicense
80 unlicense unencumbered: this is free and unencumbered software released into the public domain
80 unlicense unlicense: (?:http |https )?(?:www )?unlicense org
90 unlicense spdx: spdx license identifier unlicense
40 zlib zlib: zlib(?: libpng)? licen[cs]e
80 zlib misrepresented: the origin of this software must not be misrepresented
80 zlib warranty: this software is provided as is without any express or implied warranty
90 zlib spdx: spdx license identifier zlib
40 openssl openssl: openssl licen[cs]e
40 sspl sspl: sspl
40 sspl server: server side public licen[cs]e
40 elastic elastic: elastic licen[cs]e
60 elastic-2 elastic: elastic licen[cs]e (?:version |v ?)?2(?: 0)?
40 postgresql postgresql: postgresql licen[cs]e
40 vim vim: vim licen[cs]e
40 curl curl: curl licen[cs]e
40 json json: json licen[cs]e
80 json evil: the software shall be used for good not evil
40 beerware beerware: beerware(?: licen[cs]e)?
80 beerware beer: buy me a beer in return
40 ccby-openrail openrail: (?:creativeml )?openrail(?: m)?(?: licen[cs]e)?
40 llama-community llama: llama [0-9](?: [0-9])? community licen[cs]e
40 cc0 cc0: cc0(?: 1 0)?(?: universal)?
60 cc0 zero: creative commons zero
80 cc0 publicdomain: creativecommons org publicdomain zero(?: 1 0)?
90 cc0 spdx: spdx license identifier cc0 1 0
40 cc-by cc: cc by
40 cc-by-sa cc: cc by sa
40 cc-by-nd cc: cc by nd
40 cc-by-nc cc: cc by nc
40 cc-by-nc-sa cc: cc by nc sa
40 cc-by-nc-nd cc: cc by nc nd
60 cc-by-2 cc: cc by 2 [05]
60 cc-by-3 cc: cc by 3 0
60 cc-by-4 cc: cc by 4 0
60 cc-by-sa-2 cc: cc by sa 2 [05]
60 cc-by-sa-3 cc: cc by sa 3 0
60 cc-by-sa-4 cc: cc by sa 4 0
60 cc-by-nd-3 cc: cc by nd 3 0
60 cc-by-nd-4 cc: cc by nd 4 0
60 cc-by-nc-3 cc: cc by nc 3 0
60 cc-by-nc-4 cc: cc by nc 4 0
60 cc-by-nc-sa-3 cc: cc by nc sa 3 0
60 cc-by-nc-sa-4 cc: cc by nc sa 4 0
60 cc-by-nc-nd-3 cc: cc by nc nd 3 0
60 cc-by-nc-nd-4 cc: cc by nc nd 4 0
30 creative-commons creative: creative commons(?: licen[cs]ed?)?
45 cc-by creative: creative commons attribution(?: licen[cs]e| international| unported)*
50 cc-by-sa creative: creative commons attribution share ?alike(?: licen[cs]e| international| unported)*
50 cc-by-nd creative: creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[cs]e| international| unported)*
50 cc-by-nc creative: creative commons attribution non ?commercial(?: licen[cs]e| international| unported)*
55 cc-by-nc-sa creative: creative commons attribution non ?commercial share ?alike(?: licen[cs]e| international| unported)*
55 cc-by-nc-nd creative: creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: licen[cs]e| international| unported)*
60 cc-by-3 creative: creative commons attribution 3 0
60 cc-by-4 creative: creative commons attribution 4 0
65 cc-by-sa-3 creative: creative commons attribution share ?alike 3 0
65 cc-by-sa-4 creative: creative commons attribution share ?alike 4 0
65 cc-by-nc-4 creative: creative commons attribution non ?commercial 4 0
65 cc-by-nc-sa-4 creative: creative commons attribution non ?commercial share ?alike 4 0
65 cc-by-nc-nd-4 creative: creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0
80 cc-by creativecommons: creativecommons org licenses by(?: [1-4] [0-9])?
80 cc-by-sa creativecommons: creativecommons org licenses by sa(?: [1-4] [0-9])?
80 cc-by-nd creativecommons: creativecommons org licenses by nd(?: [1-4] [0-9])?
80 cc-by-nc creativecommons: creativecommons org licenses by nc(?: [1-4] [0-9])?
80 cc-by-nc-sa creativecommons: creativecommons org licenses by nc sa(?: [1-4] [0-9])?
80 cc-by-nc-nd creativecommons: creativecommons org licenses by nc nd(?: [1-4] [0-9])?
90 cc-by-3 spdx: spdx license identifier cc by 3 0
90 cc-by-4 spdx: spdx license identifier cc by 4 0
90 cc-by-sa-3 spdx: spdx license identifier cc by sa 3 0
90 cc-by-sa-4 spdx: spdx license identifier cc by sa 4 0
90 cc-by-nc-4 spdx: spdx license identifier cc by nc 4 0
90 cc-by-nc-sa-4 spdx: spdx license identifier cc by nc sa 4 0
90 cc-by-nc-nd-4 spdx: spdx license identifier cc by nc nd 4 0
50 public-domain domain: (?:released|dedicated|placed|is|are) (?:in|into|to) the public domain
50 public-domain domain: public domain(?: work| software| dedication)?
50 open-government government: open government licen[cs]e
60 open-government-3 government: open government licen[cs]e (?:version |v ?)?3(?: 0)?
40 proprietary rights: all rights reserved
50 proprietary proprietary: proprietary and confidential
50 proprietary confidential: confidential and proprietary
50 proprietary unauthorized: unauthorized (?:copying|use|reproduction|distribution)(?: or use)? of this (?:file|text|document|work|software)
50 proprietary prohibited: strictly prohibited without (?:the )?(?:prior )?(?:written )?(?:permission|consent)
50 proprietary permission: no part of this (?:publication|work|book|document) may be reproduced .{1,100} without (?:the )?(?:prior )?(?:written )?permission
40 commercial commercial: commercial licen[cs]e (?:agreement|required)
40 eula eula: eula
40 eula user: end user licen[cs]e agreement
"""

#: How sure a detection is, by the tens of its priority.
CONFIDENCE = {3: 0.8, 4: 0.85, 5: 0.9, 6: 0.95, 7: 0.95, 8: 0.95, 9: 1.0}
_LINE = re.compile(r"(\d+) (\S+) (\S+): (.+)")


@dataclass(frozen=True)
class Rule:
    order: int
    priority: int
    label: str
    keyword: str
    pattern: str

    @property
    def confidence(self) -> float:
        return CONFIDENCE[self.priority // 10]


def rules() -> list[Rule]:
    lines = [_LINE.fullmatch(line) for line in RULES.strip().splitlines()]
    return [Rule(i, int(m[1]), *m.groups()[1:]) for i, m in enumerate(lines)]


def keywords() -> list[str]:
    return sorted({r.keyword for r in rules()})
