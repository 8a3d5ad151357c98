"""The signature rules of the license scan, written by hand.

A line reads: words that gate the rule, label, regex over lower-cased words with single spaces between. "a|b" means that
each match holds a or b, "a|b + c|d" that it holds c or d as well. {grant}, {under}, {v} and {cc} stand for the
fragments below. Sections are in order of priority.
"""

from __future__ import annotations

import re

FRAGMENTS = {
    "{grant}": "(?:licensed|released|distributed|redistributed|published|available|provided|covered|shared) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?",
    "{under}": "(?:under|terms of|governed by|subject to|according to) (?:the )?(?:terms of )?(?:the )?",
    "{v}": "(?: version | v ?| )",
    "{cc}": "(?: [1-4] [05])?(?: international| unported)?",
}

#: Identifiers in tags, headers and package metadata.
TAGS = r"""
spdx ; mit ; spdx license identifier mit
spdx ; mit-0 ; spdx license identifier mit 0
spdx ; apache-2.0 ; spdx license identifier apache 2 0
spdx ; apache-1.1 ; spdx license identifier apache 1 1
spdx ; gpl-1.0 ; spdx license identifier gpl 1 0(?: only| or later)?
spdx ; gpl-2.0 ; spdx license identifier gpl 2 0(?: only| or later)?
spdx ; gpl-2.0-with-exception ; spdx license identifier gpl 2 0(?: only| or later)? with (?:linux syscall note|classpath exception 2 0|gcc exception 3 1)
spdx ; gpl-3.0 ; spdx license identifier gpl 3 0(?: only| or later)?
spdx ; lgpl-2.0 ; spdx license identifier lgpl 2 0(?: only| or later)?
spdx ; lgpl-2.1 ; spdx license identifier lgpl 2 1(?: only| or later)?
spdx ; lgpl-3.0 ; spdx license identifier lgpl 3 0(?: only| or later)?
spdx ; agpl-3.0 ; spdx license identifier agpl 3 0(?: only| or later)?
spdx ; bsd-1-clause ; spdx license identifier bsd 1 clause
spdx ; bsd-2-clause ; spdx license identifier bsd 2 clause(?: patent)?
spdx ; bsd-3-clause ; spdx license identifier bsd 3 clause(?: clear)?
spdx ; bsd-4-clause ; spdx license identifier bsd 4 clause
spdx ; 0bsd ; spdx license identifier 0bsd
spdx ; mpl-1.1 ; spdx license identifier mpl 1 1
spdx ; mpl-2.0 ; spdx license identifier mpl 2 0
spdx ; epl-1.0 ; spdx license identifier epl 1 0
spdx ; epl-2.0 ; spdx license identifier epl 2 0
spdx ; eupl-1.2 ; spdx license identifier eupl 1 2
spdx ; cddl-1.0 ; spdx license identifier cddl 1 0
spdx ; cddl-1.1 ; spdx license identifier cddl 1 1
spdx ; isc ; spdx license identifier isc
spdx ; zlib ; spdx license identifier zlib
spdx ; boost-1.0 ; spdx license identifier bsl 1 0
spdx ; busl-1.1 ; spdx license identifier busl 1 1
spdx ; unlicense ; spdx license identifier unlicense
spdx ; wtfpl ; spdx license identifier wtfpl
spdx ; artistic-2.0 ; spdx license identifier artistic 2 0
spdx ; ofl-1.1 ; spdx license identifier ofl 1 1
spdx ; python-2.0 ; spdx license identifier (?:python|psf) 2 0
spdx ; postgresql ; spdx license identifier postgresql
spdx ; cc0-1.0 ; spdx license identifier cc0 1 0
spdx ; cc-by ; spdx license identifier cc by [1-4] [05]
spdx ; cc-by-sa ; spdx license identifier cc by sa [1-4] [05]
spdx ; cc-by-nc ; spdx license identifier cc by nc [1-4] [05]
spdx ; cc-by-nd ; spdx license identifier cc by nd [1-4] [05]
spdx ; cc-by-nc-sa ; spdx license identifier cc by nc sa [1-4] [05]
spdx ; cc-by-nc-nd ; spdx license identifier cc by nc nd [1-4] [05]
spdx ; odbl-1.0 ; spdx license identifier odbl 1 0
spdx ; sspl-1.0 ; spdx license identifier sspl 1 0
osi + mit ; mit ; license osi approved mit license
osi + apache ; apache ; license osi approved apache software license
osi + bsd ; bsd ; license osi approved bsd license
osi + gplv2 ; gpl-2.0 ; license osi approved gnu general public license v2(?: or later)? gplv2
osi + gplv3 ; gpl-3.0 ; license osi approved gnu general public license v3(?: or later)? gplv3
osi + mozilla ; mpl-2.0 ; license osi approved mozilla public license 2 0 mpl 2 0
opensource + mit ; mit ; opensource org licenses? mit(?: license)?(?: php)?
opensource + apache ; apache-2.0 ; opensource org licenses? apache 2 0
opensource + bsd ; bsd-2-clause ; opensource org licenses? bsd 2 clause
opensource + bsd ; bsd-3-clause ; opensource org licenses? bsd 3 clause
opensource + isc ; isc ; opensource org licenses? isc(?: license)?
opensource + zlib ; zlib ; opensource org licenses? zlib(?: license)?
apache + licenses ; apache-2.0 ; apache org licenses license 2 0(?: txt| html)?
apache + licenses ; apache-1.1 ; apache org licenses license 1 1(?: txt)?
gnu + gpl ; gpl-2.0 ; gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
gnu + gpl ; gpl-3.0 ; gnu org licenses gpl 3 0(?: html| txt| en html)?
gnu + lgpl ; lgpl-2.1 ; gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
gnu + lgpl ; lgpl-3.0 ; gnu org licenses lgpl 3 0(?: html| txt)?
gnu + agpl ; agpl-3.0 ; gnu org licenses agpl 3 0(?: html| txt)?
gnu + fdl ; gfdl ; gnu org (?:licenses|copyleft) fdl(?: 1 [1-3])?(?: html| txt)?
mozilla + mpl ; mpl-2.0 ; mozilla org mpl 2 0
mozilla + mpl ; mpl-1.1 ; mozilla org mpl mpl 1 1(?: html)?
eclipse + legal ; epl-1.0 ; eclipse org legal epl v10(?: html)?
eclipse + legal ; epl-2.0 ; eclipse org legal epl (?:2 0|v20)(?: html)?
boost + license ; boost-1.0 ; boost org license 1 0(?: txt)?
creativecommons + zero ; cc0-1.0 ; creativecommons org publicdomain zero 1 0
creativecommons + mark ; public-domain ; creativecommons org publicdomain mark 1 0
creativecommons + by ; cc-by ; creativecommons org licenses by [1-4] [05]
creativecommons + sa ; cc-by-sa ; creativecommons org licenses by sa [1-4] [05]
creativecommons + nc ; cc-by-nc ; creativecommons org licenses by nc [1-4] [05]
creativecommons + nd ; cc-by-nd ; creativecommons org licenses by nd [1-4] [05]
creativecommons + nc ; cc-by-nc-sa ; creativecommons org licenses by nc sa [1-4] [05]
creativecommons + nc ; cc-by-nc-nd ; creativecommons org licenses by nc nd [1-4] [05]
unlicense + org ; unlicense ; (?:https? )?unlicense org
wtfpl + net ; wtfpl ; wtfpl net
sil|ofl + org ; ofl-1.1 ; scripts sil org ofl
opendatacommons ; odbl-1.0 ; opendatacommons org licenses odbl(?: 1 0)?
opendatacommons ; odc-by ; opendatacommons org licenses by(?: 1 0)?
opendatacommons ; pddl ; opendatacommons org licenses pddl(?: 1 0)?
"""

#: Grants by name, and sentences of the licenses' own texts.
GRANTS = r"""
mit ; mit ; {grant}mit(?: x11)?(?: licen[cs]e)?
mit ; mit-0 ; {grant}mit (?:no attribution|0)(?: licen[cs]e)?
expat ; mit ; {grant}expat(?: mit)?(?: licen[cs]e)?
x11 ; x11 ; {grant}x11 licen[cs]e
apache|apache2 ; apache-2.0 ; {grant}apache(?: software)?(?: licen[cs]e)?{v}?2(?: 0)?(?: licen[cs]e)?
apache ; apache-1.1 ; {grant}apache(?: software)?(?: licen[cs]e)?{v}1 1
apache ; apache ; {grant}apache(?: software)?(?: licen[cs]e)?
apache ; apache-2.0 ; you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0
general ; gpl-2.0 ; {grant}gnu general public licen[cs]e(?: gpl)?{v}2(?: 0)?(?: or (?:at your option )?(?:any )?later)?
general ; gpl-3.0 ; {grant}gnu general public licen[cs]e(?: gpl)?{v}3(?: 0)?(?: or (?:at your option )?(?:any )?later)?
general + public ; gpl ; {grant}(?:gnu )?general public(?: licen[cs]e)?
general + foundation ; gpl-2.0 ; general public license as published by the free software foundation either version 2 of the license
general + foundation ; gpl-3.0 ; general public license as published by the free software foundation either version 3 of the license
gpl|gpl2 ; gpl-2.0 ; {grant}(?:gnu )?gpl{v}?2(?: 0)?(?: licen[cs]e)?
gplv2 ; gpl-2.0 ; {grant}(?:gnu )?gplv2(?: licen[cs]e)?
gpl|gpl3 ; gpl-3.0 ; {grant}(?:gnu )?gpl{v}?3(?: 0)?(?: licen[cs]e)?
gplv3 ; gpl-3.0 ; {grant}(?:gnu )?gplv3(?: licen[cs]e)?
gpl ; gpl ; {grant}(?:gnu )?gpl(?: licen[cs]e)?
lesser ; lgpl-2.1 ; {grant}gnu lesser general public licen[cs]e{v}2 1
lesser ; lgpl-3.0 ; {grant}gnu lesser general public licen[cs]e{v}3(?: 0)?
lesser ; lgpl ; {grant}(?:gnu )?lesser general public(?: licen[cs]e)?
library + general ; lgpl-2.0 ; {grant}(?:gnu )?library general public licen[cs]e(?:{v}2(?: 0)?)?
lgpl|lgpl2|lgpl3 ; lgpl ; {grant}(?:gnu )?lgpl(?:{v}?[23](?: [01])?)?(?: licen[cs]e)?
affero ; agpl-3.0 ; {grant}gnu affero general public licen[cs]e{v}3(?: 0)?
affero ; agpl ; {grant}(?:gnu )?affero general public(?: licen[cs]e)?
agpl|agpl3|agplv|agplv3 ; agpl-3.0 ; {grant}(?:gnu )?agpl(?:v ?|{v})?3(?: 0)?(?: licen[cs]e)?
bsd ; bsd-2-clause ; {grant}(?:simplified bsd|freebsd bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?
bsd ; bsd-3-clause ; {grant}(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd ; bsd-4-clause ; {grant}(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?
bsd ; bsd ; {grant}bsd(?: style)?(?: licen[cs]e)?
mozilla ; mpl-2.0 ; {grant}mozilla public licen[cs]e{v}2(?: 0)?
mozilla ; mpl-2.0 ; subject to the terms of the mozilla public license v 2 0
mozilla ; mpl-1.1 ; subject to the mozilla public license version 1 1
mpl|mpl2 ; mpl-2.0 ; {grant}mpl{v}?2(?: 0)?(?: licen[cs]e)?
eclipse ; epl-1.0 ; {grant}eclipse public licen[cs]e{v}1(?: 0)?
eclipse ; epl-2.0 ; {grant}eclipse public licen[cs]e{v}2(?: 0)?
european ; eupl-1.2 ; {grant}european union public licen[cs]e(?:{v}1 [12])?
isc ; isc ; {grant}isc(?: licen[cs]e)?
zlib ; zlib ; {grant}zlib(?: libpng)?(?: licen[cs]e)?
boost ; boost-1.0 ; {grant}boost software licen[cs]e(?:{v}1(?: 0)?)?
artistic ; artistic-2.0 ; {grant}artistic licen[cs]e{v}2(?: 0)?
artistic ; artistic ; {grant}(?:perl )?artistic licen[cs]e
sil ; ofl-1.1 ; {grant}sil open font licen[cs]e(?:{v}1 1)?
unlicense ; unlicense ; {grant}unlicense
wtfpl ; wtfpl ; {grant}wtfpl
cddl ; cddl ; {grant}cddl(?:{v}1 [01])?
odbl ; odbl-1.0 ; {grant}odbl(?: 1 0)?
database ; odbl-1.0 ; {grant}open database licen[cs]e(?: odbl)?(?:{v}1 0)?
cc0 ; cc0-1.0 ; {grant}(?:creative commons )?cc0(?: 1 0)?
creative + zero ; cc0-1.0 ; {grant}creative commons zero(?: 1 0)?
cc + by ; cc-by ; {grant}cc by{cc}
cc + sa ; cc-by-sa ; {grant}cc by sa{cc}
cc + nc ; cc-by-nc ; {grant}cc by nc{cc}
cc + nd ; cc-by-nd ; {grant}cc by nd{cc}
cc + nc ; cc-by-nc-sa ; {grant}cc by nc sa{cc}
cc + nc ; cc-by-nc-nd ; {grant}cc by nc nd{cc}
creative + attribution ; cc-by ; {grant}creative commons attribution{cc} licen[cs]e
creative + attribution ; cc-by-sa ; {grant}creative commons attribution share ?alike{cc} licen[cs]e
creative + attribution ; cc-by-nc ; {grant}creative commons attribution non ?commercial{cc} licen[cs]e
creative + attribution ; cc-by-nd ; {grant}creative commons attribution no ?deriv(?:ative)?s{cc} licen[cs]e
creative + attribution ; cc-by-nc-sa ; {grant}creative commons attribution non ?commercial share ?alike{cc} licen[cs]e
creative + attribution ; cc-by-nc-nd ; {grant}creative commons attribution non ?commercial no ?deriv(?:ative)?s{cc} licen[cs]e
commercial ; commercial ; {grant}commercial licen[cs]e
proprietary ; proprietary ; {grant}proprietary licen[cs]e
permission + charge ; permission-granted ; permission is hereby granted free of charge(?: to any person obtaining a copy)?
permission + fee ; isc ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
permission + fee ; historical-permission ; permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee
redistribution + binary ; redistribution-permitted ; redistribution and use in source and binary forms with or without modification are permitted
unencumbered ; unlicense ; this is free and unencumbered software released into the public domain
altered + misrepresented ; zlib ; altered source versions must be plainly marked as such and must not be misrepresented
fuck ; wtfpl ; you just do what the fuck you want to
endorse + contributors ; bsd-3-clause ; nor the names of its contributors may be used to endorse or promote products
advertising + acknowledgement|acknowledgment ; bsd-4-clause ; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
domain + public ; public-domain ; (?:released|dedicated|placed|donated) (?:in|into|to) the public domain
waived|waive + neighboring|neighbouring ; public-domain ; waived? all copyright and related (?:or|and) neighbou?ring rights
"""

#: Names with a version, a lead or the word license.
NAMES = r"""
mit ; mit ; {under}mit(?: licen[cs]e)?
mit ; mit ; licen[cs]e mit
mit ; mit-0 ; mit no attribution
apache|apache2 ; apache-2.0 ; {under}apache(?: software)?(?: licen[cs]e)?{v}?2(?: 0)?(?: licen[cs]e)?
apache|apache2 ; apache-2.0 ; apache(?: software)?{v}?2(?: 0)? licen[cs]e
apache ; apache-2.0 ; apache(?: software)?(?: licen[cs]e{v}2(?: 0)?|{v}2 0)
apache ; apache-1.1 ; apache(?: software)? licen[cs]e{v}1 1
apache ; apache ; {under}apache(?: software)?(?: licen[cs]e)?
apache ; apache ; licen[cs]e apache
general ; gpl-1.0 ; general public licen[cs]e{v}1(?: 0)?
general ; gpl-2.0 ; (?:{under})?(?:gnu )?general public licen[cs]e(?: gpl)?{v}2(?: 0)?
general ; gpl-3.0 ; (?:{under})?(?:gnu )?general public licen[cs]e(?: gpl)?{v}3(?: 0)?
general + public ; gpl ; {under}(?:gnu )?general public(?: licen[cs]e)?
general + exception ; gpl-with-exception ; general public license (?:version [23] )?with (?:the )?(?:classpath|linking|gcc runtime library|bison|autoconf|font) exception
gpl|gpl2 ; gpl-2.0 ; (?:{under}|licen[cs]e )?(?:gnu )?gpl{v}?2(?: 0)?(?: or later)?
gplv2 ; gpl-2.0 ; (?:{under}|licen[cs]e )?(?:gnu )?gplv2
gpl|gpl3 ; gpl-3.0 ; (?:{under}|licen[cs]e )?(?:gnu )?gpl{v}?3(?: 0)?(?: or later)?
gplv3 ; gpl-3.0 ; (?:{under}|licen[cs]e )?(?:gnu )?gplv3
gpl ; gpl ; (?:{under}|licen[cs]e |gnu )gpl
gpl + exception ; gpl-with-exception ; gpl with (?:the )?(?:classpath|linking|linux syscall) exception
gpl ; gpl-compatible ; gpl compatible(?: licen[cs]e)?
lesser ; lgpl-2.1 ; (?:gnu )?lesser general public licen[cs]e{v}2 1
lesser ; lgpl-3.0 ; (?:gnu )?lesser general public licen[cs]e{v}3(?: 0)?
lesser ; lgpl ; {under}(?:gnu )?lesser general public(?: licen[cs]e)?
library + general ; lgpl-2.0 ; (?:gnu )?library general public licen[cs]e{v}2(?: 0)?
lgpl|lgpl2|lgpl3 ; lgpl ; (?:{under}|licen[cs]e |gnu )?lgpl{v}?[23](?: [01])?
lgplv2|lgplv3 ; lgpl ; lgplv[23](?: 1)?
affero ; agpl-3.0 ; (?:gnu )?affero general public licen[cs]e{v}3(?: 0)?
affero ; agpl ; {under}(?:gnu )?affero general public(?: licen[cs]e)?
agpl|agpl3|agplv|agplv3 ; agpl-3.0 ; (?:{under}|licen[cs]e |gnu )?agpl(?:v ?|{v})?3(?: 0)?
fdl|gfdl ; gfdl ; (?:gnu fdl|gfdl)(?:{v}1 [1-3])?
documentation + free ; gfdl ; gnu free documentation licen[cs]e(?:{v}1 [1-3])?
bsd ; bsd-2-clause ; (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[cs]e)?
bsd ; bsd-3-clause ; (?:bsd 3 clause|3 clause bsd|three clause bsd|modified bsd|new bsd|revised bsd)(?: licen[cs]e)?
bsd ; bsd-4-clause ; (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[cs]e)?
bsd ; 0bsd ; (?:bsd zero clause|zero clause bsd)(?: licen[cs]e)?
0bsd ; 0bsd ; 0bsd
bsd ; bsd ; {under}bsd(?: licen[cs]e)?
bsd ; bsd ; licen[cs]e bsd
mozilla ; mpl-1.0 ; mozilla public licen[cs]e{v}1 0
mozilla ; mpl-1.1 ; mozilla public licen[cs]e{v}1 1
mozilla ; mpl-2.0 ; mozilla public licen[cs]e{v}2(?: 0)?
mozilla ; mpl ; {under}mozilla public(?: licen[cs]e)?
mpl ; mpl-1.1 ; mpl{v}1 1
mpl|mpl2 ; mpl-2.0 ; (?:{under}|licen[cs]e )?mpl{v}?2(?: 0)?
eclipse ; epl-1.0 ; eclipse public licen[cs]e{v}1(?: 0)?
eclipse ; epl-2.0 ; eclipse public licen[cs]e{v}2(?: 0)?
eclipse ; edl-1.0 ; eclipse distribution licen[cs]e(?:{v}1(?: 0)?)?
epl ; epl-1.0 ; epl{v}1 0
epl ; epl-2.0 ; epl{v}2 0
european ; eupl-1.1 ; european union public licen[cs]e{v}1 1
european ; eupl-1.2 ; european union public licen[cs]e{v}1 2
eupl ; eupl ; (?:{under}|licen[cs]e )eupl(?:{v}1 [12])?
cddl ; cddl-1.0 ; cddl{v}1 0
cddl ; cddl-1.1 ; cddl{v}1 1
common + distribution ; cddl ; common development and distribution licen[cs]e(?:{v}1 [01])?
common + public ; cpl-1.0 ; common public licen[cs]e(?:{v}1 0)?
isc ; isc ; (?:{under}isc|licen[cs]e isc)
isc ; isc ; isc licen[cs]e
zlib ; zlib ; (?:{under}zlib|licen[cs]e zlib)
zlib ; zlib ; zlib(?: libpng)? licen[cs]e
boost ; boost-1.0 ; boost software licen[cs]e(?:{v}1(?: 0)?)?
bsl ; boost-1.0 ; (?:{under}|licen[cs]e )bsl 1 0
business + source ; busl-1.1 ; business source licen[cs]e(?:{v}1 1)?
server + side ; sspl-1.0 ; server side public licen[cs]e(?:{v}1)?
elastic ; elastic-2.0 ; elastic licen[cs]e(?:{v}2(?: 0)?)?
artistic ; artistic-1.0 ; artistic licen[cs]e{v}1 0
artistic ; artistic-2.0 ; artistic licen[cs]e{v}2(?: 0)?
perl ; artistic-or-gpl ; (?:same|under the) terms as perl(?: itself)?
sil ; ofl-1.1 ; sil open font(?: licen[cs]e)?(?:{v}1 1)?
ofl ; ofl-1.1 ; (?:{under}|licen[cs]e )ofl(?: 1 1)?
unlicense ; unlicense ; (?:{under}unlicense|licen[cs]e unlicense)
wtfpl ; wtfpl ; (?:{under}wtfpl|licen[cs]e wtfpl)
fuck ; wtfpl ; do what the fuck you want to public licen[cs]e
beerware|beer ; beerware ; beer ?ware licen[cs]e
openssl ; openssl ; openssl licen[cs]e
php ; php ; php licen[cs]e(?:{v}3 0(?: 1)?)?
ruby ; ruby ; (?:ruby licen[cs]e|same terms as ruby)
postgresql ; postgresql ; postgresql licen[cs]e
python ; python-2.0 ; python software foundation licen[cs]e(?:{v}2)?
psf ; python-2.0 ; psf licen[cs]e
educational ; ecl-2.0 ; educational community licen[cs]e(?:{v}2 0)?
academic ; afl-3.0 ; academic free licen[cs]e(?:{v}3 0)?
open + software ; osl-3.0 ; open software licen[cs]e(?:{v}3 0)?
microsoft ; ms-pl ; microsoft public licen[cs]e
microsoft ; ms-rl ; microsoft reciprocal licen[cs]e
ncsa ; ncsa ; (?:university of illinois )?ncsa(?: open source)? licen[cs]e
mulan ; mulan-psl-2.0 ; mulan (?:permissive software|psl)(?: licen[cs]e)?(?:{v}2)?
cecill ; cecill ; cecill(?: [bc])?(?: licen[cs]e)?(?:{v}2 [01])?
vim ; vim ; vim licen[cs]e
tex|latex ; lppl ; (?:la)?tex project public licen[cs]e
odbl ; odbl-1.0 ; odbl(?:{v}1 0| licen[cs]e)
database ; odbl-1.0 ; open database licen[cs]e
data + commons ; odc-by ; open data commons attribution(?: licen[cs]e)?
data + commons ; pddl ; open data commons public domain dedication(?: and licen[cs]e)?
government ; ogl-3.0 ; open government licen[cs]e(?:{v}3 0)?
community + data ; cdla ; community data licen[cs]e agreement
responsible + ai ; openrail ; responsible ai licen[cs]e
openrail ; openrail ; (?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?
llama ; llama-community ; llama (?:[234] (?:[0-9] )?)?community licen[cs]e
cc0 ; cc0-1.0 ; (?:{under}|licen[cs]e )?cc0(?: 1 0)?(?: universal)?
creative + zero ; cc0-1.0 ; creative commons zero
cc + by ; cc-by ; cc by{cc}
cc + sa ; cc-by-sa ; cc by sa{cc}
cc + nc ; cc-by-nc ; cc by nc{cc}
cc + nd ; cc-by-nd ; cc by nd{cc}
cc + nc ; cc-by-nc-sa ; cc by nc sa{cc}
cc + nc ; cc-by-nc-nd ; cc by nc nd{cc}
creative + attribution ; cc-by ; creative commons attribution{cc}(?: licen[cs]e)?
creative + attribution ; cc-by-sa ; creative commons attribution share ?alike{cc}(?: licen[cs]e)?
creative + attribution ; cc-by-nc ; creative commons attribution non ?commercial{cc}(?: licen[cs]e)?
creative + attribution ; cc-by-nd ; creative commons attribution no ?deriv(?:ative)?s{cc}(?: licen[cs]e)?
creative + attribution ; cc-by-nc-sa ; creative commons attribution non ?commercial share ?alike{cc}(?: licen[cs]e)?
creative + attribution ; cc-by-nc-nd ; creative commons attribution non ?commercial no ?deriv(?:ative)?s{cc}(?: licen[cs]e)?
redistribution + source ; redistribution-permitted ; redistribution and use in source and binary forms
redistribute ; no-redistribution ; (?:you )?may not (?:copy or )?redistribute
reproduced ; no-reproduction ; (?:may|must) not be reproduced(?: in any form)?
reproduced ; no-reproduction ; no part of this (?:book|publication|document|work) may be reproduced
proprietary ; proprietary ; proprietary and confidential
confidential ; proprietary ; confidential and proprietary
unauthorized|unauthorised + copying ; proprietary ; unauthori[sz]ed copying of this (?:file|software|document)
trade + secrets ; proprietary ; contains trade secrets
personal + use ; personal-use ; for personal(?: and)? non ?commercial use only
research + purposes ; research-only ; for (?:academic |non ?commercial )?research purposes only
evaluation + only ; evaluation-only ; for evaluation (?:purposes )?only
noncommercial|commercial + use ; non-commercial ; for non ?commercial use only
"""

#: Names alone and short notices.
MENTIONS = r"""
mit ; mit ; mit licen[cs]e
apache ; apache ; apache(?: software)? licen[cs]e
general ; gpl ; (?:gnu )?general public licen[cs]e
gpl ; gpl ; gpl licen[cs]e
lesser ; lgpl ; (?:gnu )?lesser general public licen[cs]e
library + general ; lgpl ; (?:gnu )?library general public licen[cs]e
lgpl ; lgpl ; lgpl(?: licen[cs]e)?
affero ; agpl ; (?:gnu )?affero general public licen[cs]e
agpl ; agpl ; agpl(?: licen[cs]e)?
bsd ; bsd ; bsd(?: style| like)? licen[cs]e
mozilla ; mpl ; mozilla public licen[cs]e
mpl ; mpl ; mpl licen[cs]e
eclipse ; epl ; eclipse public licen[cs]e
epl ; epl ; epl licen[cs]e
european ; eupl ; european union public licen[cs]e
cddl ; cddl ; cddl licen[cs]e
artistic ; artistic ; artistic licen[cs]e
unlicense ; unlicense ; unlicense licen[cs]e
wtfpl ; wtfpl ; wtfpl licen[cs]e
creative + commons ; creative-commons ; creative commons(?: licen[cs]e)?
reserved ; all-rights-reserved ; (?:copyright (?:c )?(?:[0-9]{4} )?(?:by )?)?all rights reserved
reserved ; some-rights-reserved ; some rights reserved
domain + public ; public-domain ; in the public domain
warranty ; no-warranty ; (?:provided )?as is without (?:any )?warranty
warranties ; no-warranty ; without warranties or conditions of any kind
merchantability ; no-warranty ; implied warrant(?:y|ies) of merchantability
copyleft ; copyleft ; copyleft
"""

#: (rules, priority, confidence)
SECTIONS = ((TAGS, 4, 0.99), (GRANTS, 3, 0.95), (NAMES, 2, 0.85), (MENTIONS, 1, 0.7))
PRIORITIES = (1, 2, 3, 4)


def rule_rows() -> list[tuple[list[str], list[str], str, str, int, float]]:
    """(keywords, cues, regex, label, priority, confidence) of every rule; each match holds a keyword and a cue as words."""
    rows = []
    for lines, priority, confidence in SECTIONS:
        for line in lines.strip().splitlines():
            gate, label, regex = line.split(" ; ", 2)
            keywords, *cues = (group.split("|") for group in gate.split(" + "))
            rows.append((keywords, cues[0] if cues else keywords, re.sub(r"\{[a-z]+\}", lambda m: FRAGMENTS[m[0]], regex), label, priority, confidence))
    return rows
