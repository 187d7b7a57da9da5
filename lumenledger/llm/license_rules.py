"""Signature rules of the license scan, in the order of their priority.

A line is a label, the words that must all be in the text, and a regex over the text's
lower-cased words, which are joined by one space (so ``Apache-2.0`` reads ``apache 2 0``). Each
section has the confidence of its rules; within a section the earlier rule goes first. {under}
stands for the words that grant a license: licensed under the terms of the, and the like.
"""

UNDER = r"(?:dual )?(?:licen[cs]ed|released|distributed|published|available|provided|covered|redistribut(?:e|ed)) (?:under|by|with) (?:the )?(?:terms of (?:the )?|conditions of (?:the )?)?"

SECTIONS: list[tuple[float, str]] = [
    # Machine-readable identifiers.
    (1.0, r"""
agpl-1.0-only | spdx agpl | spdx licen[cs]e identifier agpl 1 0(?: only)?
agpl-3.0-or-later | spdx agpl | spdx licen[cs]e identifier agpl 3 0 or later
agpl-3.0-only | spdx agpl | spdx licen[cs]e identifier agpl 3 0(?: only)?
lgpl-2.0-or-later | spdx lgpl | spdx licen[cs]e identifier lgpl 2 0 or later
lgpl-2.0-only | spdx lgpl | spdx licen[cs]e identifier lgpl 2 0(?: only)?
lgpl-2.1-or-later | spdx lgpl | spdx licen[cs]e identifier lgpl 2 1 or later
lgpl-2.1-only | spdx lgpl | spdx licen[cs]e identifier lgpl 2 1(?: only)?
lgpl-3.0-or-later | spdx lgpl | spdx licen[cs]e identifier lgpl 3 0 or later
lgpl-3.0-only | spdx lgpl | spdx licen[cs]e identifier lgpl 3 0(?: only)?
gpl-1.0 | spdx gpl | spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
gpl-2.0-with-classpath | spdx gpl classpath | spdx licen[cs]e identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
gpl-2.0-linux-syscall-note | spdx gpl syscall | spdx licen[cs]e identifier gpl 2 0(?: only| or later)? with linux syscall note
gpl-2.0-or-later | spdx gpl | spdx licen[cs]e identifier gpl 2 0 or later
gpl-2.0-only | spdx gpl | spdx licen[cs]e identifier gpl 2 0(?: only)?
gpl-3.0-or-later | spdx gpl | spdx licen[cs]e identifier gpl 3 0 or later
gpl-3.0-only | spdx gpl | spdx licen[cs]e identifier gpl 3 0(?: only)?
gfdl | spdx gfdl | spdx licen[cs]e identifier gfdl 1 [123](?: only| or later)?
apache-llvm | spdx apache llvm | spdx licen[cs]e identifier apache 2 0 with llvm exception
apache-1.0 | spdx apache | spdx licen[cs]e identifier apache 1 0
apache-1.1 | spdx apache | spdx licen[cs]e identifier apache 1 1
apache-2.0 | spdx apache | spdx licen[cs]e identifier apache 2 0
mit-0 | spdx mit | spdx licen[cs]e identifier mit 0
mit-cmu | spdx mit cmu | spdx licen[cs]e identifier mit cmu
mit | spdx mit | spdx licen[cs]e identifier mit
x11 | spdx x11 | spdx licen[cs]e identifier x11
bsd-0-clause | spdx 0bsd | spdx licen[cs]e identifier 0bsd
bsd-1-clause | spdx bsd | spdx licen[cs]e identifier bsd 1 clause
bsd-2-clause-patent | spdx bsd patent | spdx licen[cs]e identifier bsd 2 clause patent
bsd-2-clause | spdx bsd | spdx licen[cs]e identifier bsd 2 clause(?: freebsd| views)?
bsd-3-clause-clear | spdx bsd clear | spdx licen[cs]e identifier bsd 3 clause clear
bsd-3-clause-lbnl | spdx bsd lbnl | spdx licen[cs]e identifier bsd 3 clause lbnl
bsd-3-clause | spdx bsd | spdx licen[cs]e identifier bsd 3 clause
bsd-4-clause | spdx bsd | spdx licen[cs]e identifier bsd 4 clause(?: uc)?
mpl-1.0 | spdx mpl | spdx licen[cs]e identifier mpl 1 0
mpl-1.1 | spdx mpl | spdx licen[cs]e identifier mpl 1 1
mpl-2.0 | spdx mpl | spdx licen[cs]e identifier mpl 2 0(?: no copyleft exception)?
epl-1.0 | spdx epl | spdx licen[cs]e identifier epl 1 0
epl-2.0 | spdx epl | spdx licen[cs]e identifier epl 2 0
eupl | spdx eupl | spdx licen[cs]e identifier eupl 1 [012]
cddl-1.0 | spdx cddl | spdx licen[cs]e identifier cddl 1 0
cddl-1.1 | spdx cddl | spdx licen[cs]e identifier cddl 1 1
cpl-1.0 | spdx cpl | spdx licen[cs]e identifier cpl 1 0
cecill | spdx cecill | spdx licen[cs]e identifier cecill(?: [bc12](?: [01])?)?
isc | spdx isc | spdx licen[cs]e identifier isc
zlib | spdx zlib | spdx licen[cs]e identifier zlib(?: acknowledgement)?
libpng | spdx libpng | spdx licen[cs]e identifier libpng(?: 2 0)?
boost-1.0 | spdx bsl | spdx licen[cs]e identifier bsl 1 0
busl-1.1 | spdx busl | spdx licen[cs]e identifier busl 1 1
artistic-1.0 | spdx artistic | spdx licen[cs]e identifier artistic 1 0(?: perl| cl8)?
artistic-2.0 | spdx artistic | spdx licen[cs]e identifier artistic 2 0
unlicense | spdx unlicense | spdx licen[cs]e identifier unlicense
wtfpl | spdx wtfpl | spdx licen[cs]e identifier wtfpl
ofl-1.1 | spdx ofl | spdx licen[cs]e identifier ofl 1 [01](?: no rfn| rfn)?
odbl-1.0 | spdx odbl | spdx licen[cs]e identifier odbl 1 0
odc-by-1.0 | spdx odc | spdx licen[cs]e identifier odc by 1 0
pddl-1.0 | spdx pddl | spdx licen[cs]e identifier pddl 1 0
osl | spdx osl | spdx licen[cs]e identifier osl [123] [01]
afl | spdx afl | spdx licen[cs]e identifier afl [123] [012]
psf-2.0 | spdx psf | spdx licen[cs]e identifier psf 2 0
python-2.0 | spdx python | spdx licen[cs]e identifier python 2 0
php-3.0 | spdx php | spdx licen[cs]e identifier php 3 0(?:1)?
ruby | spdx ruby | spdx licen[cs]e identifier ruby
ms-pl | spdx ms | spdx licen[cs]e identifier ms pl
ms-rl | spdx ms | spdx licen[cs]e identifier ms rl
ncsa | spdx ncsa | spdx licen[cs]e identifier ncsa
upl-1.0 | spdx upl | spdx licen[cs]e identifier upl 1 0
postgresql | spdx postgresql | spdx licen[cs]e identifier postgresql
openssl | spdx openssl | spdx licen[cs]e identifier openssl
curl | spdx curl | spdx licen[cs]e identifier curl
sspl-1.0 | spdx sspl | spdx licen[cs]e identifier sspl 1 0
elastic-2.0 | spdx elastic | spdx licen[cs]e identifier elastic 2 0
polyform-noncommercial | spdx polyform | spdx licen[cs]e identifier polyform noncommercial 1 0 0
blueoak-1.0 | spdx blueoak | spdx licen[cs]e identifier blueoak 1 0 0
vim | spdx vim | spdx licen[cs]e identifier vim
w3c | spdx w3c | spdx licen[cs]e identifier w3c(?: \d+)?
cc0-1.0 | spdx cc0 | spdx licen[cs]e identifier cc0 1 0
cc-by-nc-sa | spdx cc | spdx licen[cs]e identifier cc by nc sa [1234] [05]
cc-by-nc-nd | spdx cc | spdx licen[cs]e identifier cc by nc nd [1234] [05]
cc-by-nc | spdx cc | spdx licen[cs]e identifier cc by nc [1234] [05]
cc-by-sa | spdx cc | spdx licen[cs]e identifier cc by sa [1234] [05]
cc-by-nd | spdx cc | spdx licen[cs]e identifier cc by nd [1234] [05]
cc-by-4.0 | spdx cc | spdx licen[cs]e identifier cc by [1234] [05]
license-ref | spdx licenseref | spdx licen[cs]e identifier licenseref \w+
"""),
    # Notices that grant a license, and addresses of license texts.
    (0.95, r"""
agpl-3.0-or-later | affero either | terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
lgpl-2.1-or-later | lesser either | terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version
lgpl-3.0-or-later | lesser either | terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
lgpl-2.0-or-later | library either | terms of the gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-2.0-or-later | either general foundation | it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-3.0-or-later | either general foundation | it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl-2.0-only | general published foundation | it under the terms of the gnu general public licen[cs]e(?: version 2)? as published by the free software foundation version 2(?: of the licen[cs]e)?(?! or)
gpl-3.0-only | general published foundation | it under the terms of the gnu general public licen[cs]e(?: version 3)? as published by the free software foundation version 3(?: of the licen[cs]e)?(?! or)
gpl-2.0-only | version published | it under the terms of the gnu general public licen[cs]e version 2 (?:only )?as published by the free software foundation
apache-2.0 | apache compliance | licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
apache-2.0 | apache agreements | licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements
apache-2.0 | apache org licenses | (?:https? )?www apache org licenses license 2 0(?: txt| html)?
mpl-2.0 | mozilla subject | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0 | mozilla org mpl | (?:https? )?(?:www )?mozilla org mpl 2 0
mpl-1.1 | mozilla contents | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
npl-1.1 | netscape contents | the contents of this file are subject to the netscape public licen[cs]e version 1 [01]
cddl-1.0 | development contents | the contents of this file are subject to the terms of (?:either the gnu general public licen[cs]e version 2 only gpl or )?the common development and distribution licen[cs]e
epl-1.0 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0
epl-2.0 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e(?: v)? ?2 0
eupl | eupl | licen[cs]ed under the eupl version 1 [012]
bsd | bsd governed | use of this source code is governed by a bsd style licen[cs]e that can be found in the licen[cs]e file
mit | mit governed | use of this source code is governed by an mit style licen[cs]e that can be found in the licen[cs]e file
mit | mit opensource | (?:https? )?(?:www )?opensource org licenses mit(?: license(?: php)?)?
bsd-3-clause | bsd opensource | (?:https? )?(?:www )?opensource org licenses bsd 3 clause
bsd-2-clause | bsd opensource | (?:https? )?(?:www )?opensource org licenses bsd 2 clause
isc | isc opensource | (?:https? )?(?:www )?opensource org licenses isc
boost-1.0 | boost accompanying | distributed under the boost software licen[cs]e version 1 0 see accompanying file licen[cs]e 1 0 txt
boost-1.0 | boost org | (?:https? )?www boost org licen[cs]e 1 0 txt
gpl | gnu www org | (?:https? )?www gnu org (?:copyleft|licenses) gpl(?: [23] 0)?(?: html| txt)?
lgpl | gnu lgpl | (?:https? )?www gnu org (?:copyleft|licenses) lgpl(?: [23] [01])?(?: html| txt)?
agpl | gnu agpl | (?:https? )?www gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gfdl | gnu fdl | (?:https? )?www gnu org (?:copyleft|licenses) fdl(?: 1 [123])?(?: html| txt)?
gfdl | documentation permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
unlicense | unlicense org | (?:https? )?unlicense org
wtfpl | wtfpl net | (?:https? )?(?:www )?wtfpl net
cc0-1.0 | creativecommons zero | (?:https? )?creativecommons org publicdomain zero 1 0
public-domain | creativecommons mark | (?:https? )?creativecommons org publicdomain mark 1 0
cc-by-nc-sa | creativecommons licenses | (?:https? )?creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | creativecommons licenses | (?:https? )?creativecommons org licenses by nc nd [1234] [05]
cc-by-nc | creativecommons licenses | (?:https? )?creativecommons org licenses by nc [1234] [05]
cc-by-sa | creativecommons licenses | (?:https? )?creativecommons org licenses by sa [1234] [05]
cc-by-nd | creativecommons licenses | (?:https? )?creativecommons org licenses by nd [1234] [05]
cc-by | creativecommons licenses | (?:https? )?creativecommons org licenses by [1234] [05]
artistic | perl itself | (?:it|this program|this library|this module) under the same terms as perl itself
ruby | ruby same | (?:distributed|copyrighted) .{0,60}?under the same terms as ruby(?: itself)?
ofl-1.1 | sil font | this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1
sspl-1.0 | server side | terms of the server side public licen[cs]e version 1
elastic-2.0 | elastic | licen[cs]ed under the elastic licen[cs]e(?: version)? 2 0
busl-1.1 | business governed | use of this software is governed by the business source licen[cs]e
postgresql | postgresql released | released under the postgresql licen[cs]e
php-3.0 | php subject | this source file is subject to version 3 0(?:1)? of the php licen[cs]e
psf-2.0 | psf contributor agreement | licen[cs]ed to psf under a contributor agreement
"""),
    # A name that is said to be the license of something.
    (0.92, r"""
agpl-3.0 | affero | {under}(?:gnu )?affero general public licen[cs]e (?:v ?|version )?3(?: 0)?
agpl | affero | {under}(?:gnu )?affero general public licen[cs]e
lgpl | lesser | {under}(?:gnu )?lesser general public licen[cs]e
gfdl | documentation | {under}gnu free documentation licen[cs]e
gpl-2.0 | general | {under}gnu general public licen[cs]e (?:v ?|version )?2(?: 0)?
gpl-3.0 | general | {under}gnu general public licen[cs]e (?:v ?|version )?3(?: 0)?
gpl | general | {under}gnu general public licen[cs]e
agpl | agpl | {under}(?:gnu )?agpl
lgpl | lgpl | {under}(?:gnu )?lgpl
gpl | gpl | {under}(?:gnu )?gpl
apache-2.0 | apache | {under}apache (?:software )?licen[cs]e (?:v ?|version )?2(?: 0)?
apache | apache | {under}apache (?:software )?licen[cs]e
mit | mit | {under}mit licen[cs]e
mit | mit | {under}mit(?! licen[cs]e)
bsd-3-clause | bsd | {under}(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd-2-clause | bsd | {under}(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?
bsd | bsd | {under}(?:a )?bsd(?: style)? licen[cs]e
isc | isc | {under}isc licen[cs]e
zlib | zlib | {under}zlib(?: libpng)? licen[cs]e
mpl-2.0 | mozilla | {under}mozilla public licen[cs]e (?:v ?|version )?2(?: 0)?
mpl | mozilla | {under}mozilla public licen[cs]e
epl | eclipse | {under}eclipse public licen[cs]e(?: (?:v ?|version )?[12](?: 0)?)?
eupl | european | {under}european union public licen[cs]e
cddl | distribution | {under}common development and distribution licen[cs]e
boost | boost | {under}boost software licen[cs]e
artistic | artistic | {under}artistic licen[cs]e(?: (?:v ?|version )?[12](?: 0)?)?
unlicense | unlicense | {under}unlicense
wtfpl | wtfpl | {under}wtfpl
ofl | sil | {under}sil open font licen[cs]e
odbl | database | {under}open (?:data commons open )?database licen[cs]e
cc0 | cc0 | {under}cc0(?: 1 0)?
cc-by-nc-sa | cc | {under}cc by nc sa(?: [1234] [05])?
cc-by-nc-nd | cc | {under}cc by nc nd(?: [1234] [05])?
cc-by-nc | cc | {under}cc by nc(?: [1234] [05])?
cc-by-sa | cc | {under}cc by sa(?: [1234] [05])?
cc-by-nd | cc | {under}cc by nd(?: [1234] [05])?
cc-by | cc | {under}cc by(?: [1234] [05])?
cc-by-nc-sa | creative | {under}creative commons attribution non ?commercial share ?alike
cc-by-nc | creative | {under}creative commons attribution non ?commercial
cc-by-sa | creative | {under}creative commons attribution share ?alike
cc-by | creative | {under}creative commons attribution
proprietary | proprietary | {under}(?:a )?proprietary licen[cs]e
"""),
    # Wording of the licenses themselves.
    (0.9, r"""
mit | charge deal restriction | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | noninfringement merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
x11 | consortium advertising | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | purpose hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
bsd-0-clause | purpose hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
hpnd | documentation fee hereby | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
bsd | redistribution binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions retain source | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions reproduce binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-3-clause | endorse neither | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
apache-1.1 | product includes apache | this product includes software developed by the apache software foundation
apache-2.0 | perpetual worldwide irrevocable | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e
apache-2.0 | terms reproduction distribution | apache licen[cs]e version 2 0 january 2004 (?:http www apache org licenses )?terms and conditions for use reproduction and distribution
gpl | verbatim copies changing | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
gpl-2.0 | june 1991 | gnu general public licen[cs]e version 2 june 1991
gpl-3.0 | june 2007 | gnu general public licen[cs]e version 3 29 june 2007
gpl | copyleft kinds | the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
gpl | guarantee freedom share | the gnu general public licen[cs]e is intended to guarantee your freedom to share and change
gpl | implied merchantability useful | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
lgpl | implied library useful | this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
lgpl-2.1 | february 1999 | gnu lesser general public licen[cs]e version 2 1 february 1999
lgpl-3.0 | june 2007 lesser | gnu lesser general public licen[cs]e version 3 29 june 2007
agpl-3.0 | november 2007 affero | gnu affero general public licen[cs]e version 3 19 november 2007
agpl-3.0 | interacting remotely network | your modified version must prominently offer all users interacting with it remotely through a computer network
mpl-2.0 | incompatible secondary mozilla | this source code form is incompatible with secondary licenses as defined by the mozilla public licen[cs]e
epl | agreement accompanying eclipse | the accompanying program is provided under the terms of this eclipse public licen[cs]e agreement
cpl | agreement accompanying common | the accompanying program is provided under the terms of this common public licen[cs]e agreement
zlib | altered misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | origin misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
boost-1.0 | executable machine processor | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
unlicense | unencumbered domain | this is free and unencumbered software released into the public domain
unlicense | anyone sell distribute | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | fuck want | you just do what the fuck you want to
cc0-1.0 | affirmer waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1.0 | extent waived neighboring | to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights
cc-by | appropriate credit indicate | you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made
cc-by-sa | remix transform contributions | if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e
cc-by-nc | commercial purposes | you may not use the material for commercial purposes
cc-by-nd | remix modified | if you remix transform or build upon the material you may not distribute the modified material
ofl | font sold itself | neither the font software nor any of its individual components in original or modified versions may be sold by itself
artistic | package modified provided | you may distribute modified versions of the package provided that
ms-pl | governs accompanying accept | this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e
ncsa | names endorse promote | neither the names of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
json | good evil | the software shall be used for good not evil
beerware | beer worth | if we meet some day and you think this stuff is worth it you can buy me a beer in return
postgresql | university california liable | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
busl-1.1 | change date anniversary | effective on the change date or the fourth anniversary of the first publicly available distribution
public-domain | public domain | (?:dedicated|placed|released) (?:in|to|into) the public domain
proprietary | confidential proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | unauthorized copying strictly | unauthorized copying of this file via any medium is strictly prohibited
"""),
    # Names with a version.
    (0.8, r"""
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e (?:v ?|version )?3(?: 0)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[cs]e (?:v ?|version )?2 1
lgpl-3.0 | lesser | (?:gnu )?lesser general public licen[cs]e (?:v ?|version )?3(?: 0)?
lgpl-2.0 | library | (?:gnu )?library general public licen[cs]e (?:v ?|version )?2(?: 0)?
gpl-1.0 | general | gnu general public licen[cs]e (?:v ?|version )?1(?: 0)?
gpl-2.0 | general | gnu general public licen[cs]e (?:v ?|version )?2(?: 0)?
gpl-3.0 | general | gnu general public licen[cs]e (?:v ?|version )?3(?: 0)?
agpl-3.0 | agpl | agpl (?:v ?|version )?3(?: 0)?
agpl-3.0 | agplv3 | agplv3
lgpl-2.1 | lgpl | lgpl (?:v ?|version )?2 1
lgpl-3.0 | lgpl | lgpl (?:v ?|version )?3(?: 0)?
lgpl-2.1 | lgplv2 | lgplv2(?: 1)?
lgpl-3.0 | lgplv3 | lgplv3
gpl-2.0 | gpl | (?:gnu )?gpl (?:v ?|version )?2(?: 0)?
gpl-3.0 | gpl | (?:gnu )?gpl (?:v ?|version )?3(?: 0)?
gpl-2.0 | gplv2 | (?:gnu )?gplv2
gpl-3.0 | gplv3 | (?:gnu )?gplv3
gfdl | documentation | (?:gnu )?free documentation licen[cs]e (?:v ?|version )?1 [123]
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:v ?|version )?1 1
apache-1.0 | apache | apache (?:software )?licen[cs]e (?:v ?|version )?1 0
apache-2.0 | apache | apache (?:software )?licen[cs]e (?:v ?|version )?2(?: 0)?
apache-2.0 | apache | apache (?:v ?)?2(?: 0)? licen[cs]e
mpl-1.0 | mozilla | mozilla public licen[cs]e (?:v ?|version )?1 0
mpl-1.1 | mozilla | mozilla public licen[cs]e (?:v ?|version )?1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e (?:v ?|version )?2(?: 0)?
mpl-2.0 | mpl | mpl (?:v ?|version )?2 0
epl-1.0 | eclipse | eclipse public licen[cs]e (?:v ?|version )?1(?: 0)?
epl-2.0 | eclipse | eclipse public licen[cs]e (?:v ?|version )?2(?: 0)?
eupl | european | european union public licen[cs]e (?:v ?|version )?1 [012]
cddl-1.0 | distribution | common development and distribution licen[cs]e (?:v ?|version )?1 0
cddl-1.1 | distribution | common development and distribution licen[cs]e (?:v ?|version )?1 1
cpl-1.0 | common | common public licen[cs]e (?:v ?|version )?1 0
bsd-4-clause | bsd | (?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?
bsd-3-clause | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd-2-clause | bsd | (?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?
bsd-2-clause | freebsd | freebsd licen[cs]e
bsd-0-clause | bsd | zero clause bsd(?: licen[cs]e)?
boost-1.0 | boost | boost software licen[cs]e (?:v ?|version )?1 0
artistic-1.0 | artistic | artistic licen[cs]e (?:v ?|version )?1(?: 0)?
artistic-2.0 | artistic | artistic licen[cs]e (?:v ?|version )?2(?: 0)?
osl-3.0 | open | open software licen[cs]e (?:v ?|version )?3 0
osl | open | open software licen[cs]e (?:v ?|version )?[12] [01]
afl | academic | academic free licen[cs]e (?:v ?|version )?[123] [012]
ofl-1.1 | sil | sil open font licen[cs]e (?:v ?|version )?1 [01]
odbl-1.0 | database | open (?:data commons open )?database licen[cs]e (?:v ?|version )?1 0
upl-1.0 | universal | universal permissive licen[cs]e (?:v ?|version )?1 0
php-3.0 | php | php licen[cs]e (?:v ?|version )?3 0(?:1)?
zpl | zope | zope public licen[cs]e (?:v ?|version )?[12] [01]
cc0-1.0 | cc0 | cc0 1 0(?: universal)?
cc-by-nc-sa | cc | cc by nc sa [1234] [05]
cc-by-nc-nd | cc | cc by nc nd [1234] [05]
cc-by-nc | cc | cc by nc [1234] [05]
cc-by-sa | cc | cc by sa [1234] [05]
cc-by-nd | cc | cc by nd [1234] [05]
cc-by | cc | cc by [1234] [05]
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike [1234] [05]
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s? [1234] [05]
cc-by-nc | creative | creative commons attribution non ?commercial [1234] [05]
cc-by-sa | creative | creative commons attribution share ?alike [1234] [05]
cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s? [1234] [05]
cc-by | creative | creative commons attribution [1234] [05]
"""),
    # Names alone.
    (0.6, r"""
agpl | affero | (?:gnu )?affero (?:general public )?licen[cs]e
lgpl | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | library | gnu library general public licen[cs]e
gfdl | documentation | gnu free documentation licen[cs]e
gpl | gnu | gnu general public licen[cs]e
agpl | agpl | (?:gnu )?agpl
lgpl | lgpl | (?:gnu )?lgpl
gpl | gpl | (?:gnu )?gpl
apache | apache | apache (?:software )?licen[cs]e
mit | mit | (?:the )?mit licen[cs]e
mit | expat | expat licen[cs]e
x11 | x11 | x11 licen[cs]e
bsd | bsd | bsd(?: style)? licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
edl | eclipse | eclipse distribution licen[cs]e
eupl | european | european union public licen[cs]e
cddl | cddl | cddl
cddl | distribution | common development and distribution licen[cs]e
cpl | common | common public licen[cs]e
ipl | ibm | ibm public licen[cs]e
cecill | cecill | cecill(?: [bc])?(?: free software)? licen[cs]e
isc | isc | isc licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
libpng | reference library | (?:lib)?png reference library licen[cs]e
boost | boost | boost software licen[cs]e
artistic | artistic | (?:clarified )?artistic licen[cs]e
perl | perl | perl licen[cs]e
unlicense | unlicense | unlicense
wtfpl | wtfpl | wtfpl
ofl | sil | sil open font licen[cs]e
odbl | database | open (?:data commons open )?database licen[cs]e
odc-by | commons | open data commons attribution licen[cs]e
pddl | dedication | public domain dedication and licen[cs]e
osl | open | open software licen[cs]e
afl | academic | academic free licen[cs]e
psf | python | python software foundation licen[cs]e
php | php | php licen[cs]e
ruby | ruby | ruby licen[cs]e
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[cs]e
upl | universal | universal permissive licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl licen[cs]e
sspl | server | server side public licen[cs]e
elastic | elastic | elastic licen[cs]e
busl | business | business source licen[cs]e
blueoak | oak | blue oak model licen[cs]e
polyform | polyform | polyform (?:noncommercial|small business|shield|strict) licen[cs]e
apsl | apple | apple public source licen[cs]e
npl | netscape | netscape public licen[cs]e
qpl | q | q public licen[cs]e
zpl | zope | zope public licen[cs]e
w3c | w3c | w3c software (?:and document )?(?:notice and )?licen[cs]e
vim | vim | vim licen[cs]e
beerware | beer ware | beer ware licen[cs]e
beerware | beerware | beerware licen[cs]e
cc0 | cc0 | cc0
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc | cc | cc by nc
cc-by-sa | cc | cc by sa
cc-by-nd | cc | cc by nd
cc-by | cc | cc by
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc | creative | creative commons attribution non ?commercial
cc-by-sa | creative | creative commons attribution share ?alike
cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s?
cc-by | creative | creative commons attribution
public-domain | domain | public domain
proprietary | reserved | all rights reserved
"""),
]
