"""Signature rules of the licence scan.

Rules match in a text's words, lower-cased and joined by one space, so that case, punctuation and
line breaks don't matter. A line is ``kind keyword... : pattern``; its label stands above. A rule is
tried only on texts that hold all its keywords, of ``this|that`` one of the two. Each spelling that a
pattern allows holds them, but for those with a ``+``: these must stand elsewhere in the text, as
other licences have the same passage. Kinds, in order of priority:

* ``text``: a passage of the licence itself; ``grant``: a notice that places a work under it;
* ``tag``: a short identifier after a tag word; ``title``: the licence's name;
* ``id``: an identifier by itself; ``spdx`` lines give both a ``tag`` and an ``id``;
* ``url``: its address; ``hint``: words that merely point to it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: kind -> (priority, confidence)
KINDS = {"text": (1, 0.95), "grant": (2, 0.9), "tag": (3, 0.9), "title": (4, 0.7), "id": (5, 0.7), "url": (6, 0.8), "hint": (7, 0.3)}

#: Words that open a grant, and tag words that stand before an identifier.
GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|covered|issued|shared|made available|redistributed|offered) under (?:the |an? )?(?:terms of |conditions of )?(?:the )?"
TAG = "(?:spdx license identifier|license|licence|licenses|license expression|spdx id|license name) "
VERSION = "(?:version |v ?)?"
#: Identifiers that others stand beside in an expression, and how one ends there.
IDS = "(?:apache 2 0|bsd [234] clause|gpl [123] 0|lgpl [23] [01]|agpl 3 0|mpl [12] [01]|cc0 1 0|mit|isc|zlib|unlicense|0bsd)"
ENDS = ("2 0", "3 0", "1 1", "2 1", "clause", "later", "only", "mit", "isc", "zlib", "unlicense", "0bsd")

#: Phrases that count at all their places, apart from the method's own labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

SIGNATURES = r"""
= mit
text liable holders : in no event shall the authors or copyright holders be liable for any claim damages or other liability
text deal restriction : to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
id mit or|and : {BESIDE mit}
text permission hereby granted : permission is hereby granted free of charge to any person obtaining a copy of this software
text substantial portions : the above copyright notice and this permission notice shall be included in all copies or substantial portions
grant mit : {GRANT}mit licen[sc]e
grant expat : {GRANT}(?:mit expat|expat) licen[sc]e
tag mit : {TAG}mit
title mit : (?:the )?mit licen[sc]e
title expat : expat licen[sc]e
url opensource mit : opensource org licenses mit(?: license)?
url mit license : mit license org
= mit-0
grant attribution mit : {GRANT}mit no attribution licen[sc]e
tag mit 0 : {TAG}mit 0
title attribution mit : mit no attribution
= apache-2.0
text contribution authorship : contribution shall mean any work of authorship including the original version of the work
text retain attribution : you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices
text warranties conditions : distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
text +apache governing permissions limitations : see the license for the specific language governing permissions and limitations under the license
text +apache compliance : you may not use this file except in compliance with the license
text perpetual worldwide : each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce
grant apache : {GRANT}apache (?:software )?licen[sc]e {VERSION}2(?: 0)?
grant apache : {GRANT}apache 2(?: 0)?(?: licen[sc]e)?
grant asf agreements : licensed to the apache software foundation asf under one or more contributor license agreements
spdx apache : {TAG}apache 2 0
title apache : apache (?:software )?licen[sc]e {VERSION}2(?: 0)?
title apache : apache 2 0 licen[sc]e
url apache licenses : apache org licenses license 2 0(?: html| txt)?
= apache-1.1
grant apache : {GRANT}apache (?:software )?licen[sc]e {VERSION}1 1
title apache : apache (?:software )?licen[sc]e {VERSION}1 1
spdx apache : {TAG}apache 1 1
text apache +acknowledgment|acknowledgement : this product includes software developed by the apache software foundation
= bsd-2-clause
grant bsd|freebsd : {GRANT}(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[sc]e
title bsd|freebsd : (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[sc]e
spdx bsd : {TAG}bsd 2 clause
url opensource bsd : opensource org licenses bsd 2 clause
= bsd-3-clause
text endorse promote : neither the name of (?:the )?(?:[^ ]+ ){1,8}?(?:nor the names of its contributors )?may be used to endorse or promote products derived from this software
grant bsd : {GRANT}(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd|bsd style|bsd) licen[sc]e
title bsd : (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[sc]e
spdx bsd : {TAG}bsd 3 clause
url opensource bsd : opensource org licenses bsd 3 clause
= bsd
text disclaimed merchantability : any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
text redistributions retain : redistributions of source code must retain the above copyright notice this list of conditions
text redistributions reproduce : redistributions in binary form must reproduce the above copyright notice
title bsd : bsd licen[sc]e
hint bsd : bsd style licen[sc]e
= bsd-4-clause
text advertising acknowledgement|acknowledgment : all advertising materials mentioning features or use of this software must display the following acknowledge?ment
spdx bsd : {TAG}bsd 4 clause
title bsd : (?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e
= isc
text disclaims regard : the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
id isc or|and : {BESIDE isc}
text +isc purpose : permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
text purpose appear : permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
grant isc : {GRANT}isc licen[sc]e
tag isc : {TAG}isc
title isc : isc licen[sc]e
url opensource isc : opensource org licenses isc
= gpl-1.0
grant gnu : {GRANT}gnu (?:general public licen[sc]e|gpl) {VERSION}1(?: 0)?
title gnu : gnu (?:general public licen[sc]e|gpl) {VERSION}1(?: 0)?
spdx gpl : {TAG}gpl 1 0(?: only| or later)?
= gpl-2.0
text gnu modify : modify it under the terms of (?:version 2 of the gnu general public license|the gnu general public license {VERSION}2)
text activities outside : activities other than copying distribution and modification are not covered by this license they are outside its scope
grant gnu : {GRANT}gnu (?:general public licen[sc]e|gpl) {VERSION}2(?: 0)?(?: or (?:any )?later)?
grant gpl|gpl2|gplv|gplv2|gplversion : {GRANT}gpl ?{VERSION}2(?: 0)?
grant gplv2 : {GRANT}(?:gnu )?gplv2
title gnu : gnu (?:general public licen[sc]e|gpl) {VERSION}2(?: 0)?
title gplv2 : (?:gnu )?gplv2
spdx gpl : {TAG}gpl 2 0(?: only| or later)?
text +gnu option later : either version 2 of the license or at your option any later version
url gnu gpl : gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
= gpl-3.0
text gnu modify : modify it under the terms of (?:version 3 of the gnu general public license|the gnu general public license {VERSION}3)
text gnu copyleft : the gnu general public license is a free copyleft license for software and other kinds of works
text propagate infringement : to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement
grant gnu : {GRANT}gnu (?:general public licen[sc]e|gpl) {VERSION}3(?: 0)?(?: or (?:any )?later)?
grant gpl : {GRANT}gpl {VERSION}3(?: 0)?
grant gplv3 : {GRANT}(?:gnu )?gplv3
title gnu : gnu (?:general public licen[sc]e|gpl) {VERSION}3(?: 0)?
title gplv3 : (?:gnu )?gplv3
spdx gpl : {TAG}gpl 3 0(?: only| or later)?
text +gnu option later : either version 3 of the license or at your option any later version
text verbatim convey : you may convey verbatim copies of the program s source code as you receive it
url gnu gpl : gnu org licenses gpl 3 0(?: html| txt)?
= gpl
grant gpl : {GRANT}gpl(?: licen[sc]e)?
text gnu received : you should have received a copy of the gnu general public license along with this program
text freedom designed : the licenses for most software are designed to take away your freedom to share and change it
grant gnu : {GRANT}gnu (?:general public licen[sc]e|gpl)
title gnu : gnu general public licen[sc]e
title gpl : (?:the )?gpl licen[sc]e
text gnu redistribute : you can redistribute it and or modify it under the terms of the gnu general public license
text gnu details : see the gnu general public license for more details
url gnu gpl : gnu org (?:licenses|copyleft) gpl(?: html)?
= lgpl-2.1
text library derivative linked : a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it is called a work that uses the library
grant gnu lesser : {GRANT}gnu lesser general public licen[sc]e {VERSION}2 1
title gnu lesser : gnu lesser general public licen[sc]e {VERSION}2 1
title lgplv2 : lgplv2(?: 1)?
spdx lgpl : {TAG}lgpl 2 1(?: only| or later)?
url gnu lgpl : gnu org licenses (?:old licenses )?lgpl 2 1
= lgpl-2.0
title gnu library : gnu library general public licen[sc]e
spdx lgpl : {TAG}lgpl 2 0(?: only| or later)?
= lgpl-3.0
text gnu lesser incorporates : this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
grant gnu lesser : {GRANT}gnu lesser general public licen[sc]e {VERSION}3
title gnu lesser : gnu lesser general public licen[sc]e {VERSION}3(?: 0)?
title lgplv3 : lgplv3
spdx lgpl : {TAG}lgpl 3 0(?: only| or later)?
url gnu lgpl : gnu org licenses lgpl 3 0
= lgpl
text lesser received : you should have received a copy of the gnu lesser general public license along with this
grant lesser : {GRANT}(?:gnu )?lesser (?:gnu )?general public licen[sc]e
title lesser : (?:gnu )?lesser (?:gnu )?general public licen[sc]e
title lgpl : (?:gnu )?lgpl(?: licen[sc]e)?
url gnu lgpl|lesser : gnu org (?:licenses|copyleft) (?:lgpl|lesser)(?: html)?
= agpl-3.0
text affero received : you should have received a copy of the gnu affero general public license along with this program
text affero copyleft : the gnu affero general public license is a free copyleft license for software and other kinds of works
grant affero : {GRANT}gnu affero general public licen[sc]e(?: {VERSION}3(?: 0)?)?
title affero : (?:gnu )?affero general public licen[sc]e(?: {VERSION}3(?: 0)?)?
title agplv3 : agplv3
spdx agpl : {TAG}agpl 3 0(?: only| or later)?
text remotely network : interacting with it remotely through a computer network an opportunity to receive the corresponding source
url gnu agpl : gnu org licenses agpl(?: 3 0)?
= mpl-2.0
text larger covered : you may create and distribute a larger work under terms of your choice provided that you also comply with the requirements of this license for the covered software
text mozilla incompatible : this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0
text mozilla subject : this source code form is subject to the terms of the mozilla public license v 2 0
text mpl obtain : if a copy of the mpl was not distributed with this file you can obtain one at
grant mozilla : {GRANT}mozilla public licen[sc]e {VERSION}2(?: 0)?
title mozilla : mozilla public licen[sc]e {VERSION}2(?: 0)?
spdx mpl : {TAG}mpl 2 0
url mozilla mpl : mozilla org (?:en us )?mpl 2 0
= mpl-1.1
text governing rights limitations : see the license for the specific language governing rights and limitations under the license
grant mozilla : {GRANT}mozilla public licen[sc]e {VERSION}1 1
title mozilla : mozilla public licen[sc]e {VERSION}1 1
spdx mpl : {TAG}mpl 1 1
url mozilla mpl : mozilla org mpl mpl 1 1
= mpl
grant mozilla : {GRANT}mozilla public licen[sc]e
title mozilla : mozilla public licen[sc]e
= epl-1.0
text eclipse accompanying : this program and the accompanying materials are made available under the terms of the eclipse public license {VERSION}1(?: 0)?
grant eclipse : {GRANT}eclipse public licen[sc]e {VERSION}1(?: 0)?
title eclipse : eclipse public licen[sc]e {VERSION}1(?: 0)?
tag epl : {TAG}epl 1 0
id epl : epl (?:v ?)?1 0
url eclipse epl : eclipse org legal epl v10
= epl-2.0
text eclipse accompanying : this program and the accompanying materials are made available under the terms of the eclipse public license {VERSION}2(?: 0)?
grant eclipse : {GRANT}eclipse public licen[sc]e {VERSION}2(?: 0)?
title eclipse : eclipse public licen[sc]e {VERSION}2(?: 0)?
tag epl : {TAG}epl 2 0
id epl : epl (?:v ?)?2 0
url eclipse epl : eclipse org legal epl (?:v20|2 0)
= edl-1.0
title eclipse : eclipse distribution licen[sc]e(?: {VERSION}1(?: 0)?)?
url eclipse edl : eclipse org org documents edl v10
= cddl-1.0
text development contents : the contents of this file are subject to the terms of the common development and distribution license
grant cddl|development : {GRANT}(?:common development and distribution licen[sc]e|cddl)
title development distribution : common development and distribution licen[sc]e(?: cddl)?(?: {VERSION}1(?: 0)?)?
spdx cddl : {TAG}cddl 1 0
= cddl-1.1
title development distribution : common development and distribution licen[sc]e(?: cddl)? {VERSION}1 1
spdx cddl : {TAG}cddl 1 1
= cpl-1.0
title common public : common public licen[sc]e(?: {VERSION}1(?: 0)?)?
tag cpl : {TAG}cpl 1 0
= ipl-1.0
title ibm public : ibm public licen[sc]e(?: {VERSION}1(?: 0)?)?
tag ipl : {TAG}ipl 1 0
= artistic-1.0
text intent package : the intent of this document is to state the conditions under which a package may be copied
title artistic : artistic licen[sc]e(?: {VERSION}1(?: 0)?)?
spdx artistic : {TAG}artistic 1 0
= artistic-2.0
text establishes package : this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
grant artistic : {GRANT}artistic licen[sc]e {VERSION}2(?: 0)?
title artistic : artistic licen[sc]e {VERSION}2(?: 0)?
spdx artistic : {TAG}artistic 2 0
= perl
grant perl : (?:under )?the same terms as perl(?: itself)?
= python-2.0
text psf licensee nonexclusive : psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly
id psf : psf 2 0
title python software : python software foundation licen[sc]e(?: {VERSION}2(?: 0)?)?
title psf : psf licen[sc]e(?: agreement)?
tag python|psf : {TAG}(?:python 2 0|psf 2 0)
url python license : docs python org (?:3 )?license
= ruby
grant ruby : {GRANT}(?:same terms as ruby|ruby s licen[sc]e)
title ruby : ruby licen[sc]e
= php-3.01
text php freely : this product includes php software freely available from
title php : php licen[sc]e(?: {VERSION}3(?: 01?| 0)?)?
spdx php : {TAG}php 3 01
url php license : php net license 3 01
= zlib
text held liable damages : in no event will the authors be held liable for any damages arising from the use of this software
text origin misrepresented : the origin of this software must not be misrepresented you must not claim that you wrote the original software
id zlib or|and : {BESIDE zlib}
text misrepresented altered : altered source versions must be plainly marked as such and must not be misrepresented as being the original software
grant zlib : {GRANT}zlib(?: libpng)? licen[sc]e
title zlib : zlib(?: libpng)? licen[sc]e
tag zlib : {TAG}zlib
url zlib license : zlib net zlib license
= libpng
text png supplied : the png reference library is supplied as is
title libpng|png : (?:png reference library|libpng) licen[sc]e(?: {VERSION}[12])?
tag libpng : {TAG}libpng(?: 2 0)?
= bsl-1.0
text organization accompanying : permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
grant boost : {GRANT}boost software licen[sc]e(?: {VERSION}1(?: 0)?)?
title boost : boost software licen[sc]e(?: {VERSION}1(?: 0)?)?
spdx bsl : {TAG}bsl 1 0
url boost license : boost org license 1 0(?: txt)?
= unlicense
text anyone compile binary : anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
text jurisdictions dedicate : in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
id unlicense or|and : {BESIDE unlicense}
text unencumbered domain : this is free and unencumbered software released into the public domain
grant unlicense : {GRANT}unlicense
title unlicense : the unlicense
tag unlicense : {TAG}unlicense
url unlicense org : unlicense org
= wtfpl
text verbatim changed : everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
title fuck want public : do what the fuck you want to public licen[sc]e
grant wtfpl : {GRANT}wtfpl
tag wtfpl : {TAG}wtfpl
id wtfpl : wtfpl
url wtfpl net : wtfpl net
= cc0-1.0
text affirmer contravention : to the greatest extent permitted by but not in contravention of applicable law affirmer hereby
grant cc0 : {GRANT}(?:creative commons )?cc0(?: 1 0)?(?: universal)?
title cc0 : cc0 1 0(?: universal)?
title creative zero : creative commons zero
spdx cc0 : {TAG}cc0 1 0
url creativecommons publicdomain zero : creativecommons org publicdomain zero 1 0
text waives affirmer : affirmer hereby overtly fully permanently irrevocably and unconditionally waives
= cc-by-4.0
text creative exercising : by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license
grant cc by : {GRANT}(?:creative commons )?cc by 4 0
title creative attribution : creative commons attribution 4 0(?: international)?
spdx cc by : {TAG}cc by 4 0
url creativecommons licenses by : creativecommons org licenses by 4 0
= cc-by-3.0
grant cc by : {GRANT}(?:creative commons )?cc by 3 0
title creative attribution : creative commons attribution 3 0(?: unported)?
spdx cc by : {TAG}cc by 3 0
url creativecommons licenses by : creativecommons org licenses by 3 0
= cc-by-sa-4.0
text creative exercising : by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution share ?alike 4 0 international public license
grant cc by sa : {GRANT}(?:creative commons )?cc by sa 4 0
title creative sharealike|alike : creative commons attribution share ?alike 4 0(?: international)?
spdx cc by sa : {TAG}cc by sa 4 0
url creativecommons licenses by sa : creativecommons org licenses by sa 4 0
= cc-by-sa-3.0
grant cc by sa : {GRANT}(?:creative commons )?cc by sa 3 0
title creative sharealike|alike : creative commons attribution share ?alike 3 0(?: unported)?
spdx cc by sa : {TAG}cc by sa 3 0
url creativecommons licenses by sa : creativecommons org licenses by sa 3 0
= cc-by-nc-4.0
text creative exercising : by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution non ?commercial 4 0 international public license
grant cc by nc : {GRANT}(?:creative commons )?cc by nc 4 0
title creative noncommercial|commercial : creative commons attribution non ?commercial 4 0(?: international)?
spdx cc by nc : {TAG}cc by nc 4 0
url creativecommons licenses by nc : creativecommons org licenses by nc 4 0
= cc-by-nc-sa-4.0
text creative exercising : by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution non ?commercial share ?alike 4 0 international public license
grant cc by nc sa : {GRANT}(?:creative commons )?cc by nc sa 4 0
title creative noncommercial|commercial sharealike|alike : creative commons attribution non ?commercial share ?alike 4 0(?: international)?
spdx cc by nc sa : {TAG}cc by nc sa 4 0
url creativecommons licenses by nc sa : creativecommons org licenses by nc sa 4 0
= cc-by-nc-nd-4.0
text creative exercising : by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution non ?commercial no ?derivatives 4 0 international public license
grant cc by nc nd : {GRANT}(?:creative commons )?cc by nc nd 4 0
title creative noncommercial|commercial attribution : creative commons attribution non ?commercial no ?deriv(?:ative)?s(?:atives)? 4 0
spdx cc by nc nd : {TAG}cc by nc nd 4 0
url creativecommons licenses by nc nd : creativecommons org licenses by nc nd 4 0
= cc-by-nd-4.0
text creative exercising : by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution no ?derivatives 4 0 international public license
grant cc by nd : {GRANT}(?:creative commons )?cc by nd 4 0
spdx cc by nd : {TAG}cc by nd 4 0
url creativecommons licenses by nd : creativecommons org licenses by nd 4 0
= cc-by
grant cc by : {GRANT}cc by
title creative attribution : creative commons attribution(?: licen[sc]e)?
= cc-by-sa
grant cc by sa : {GRANT}cc by sa
title cc by sa : cc by sa
= cc-by-nc
grant cc by nc : {GRANT}cc by nc
title cc by nc : cc by nc
= cc-by-nd
title cc by nd : cc by nd
= creative-commons
text redistribute medium : share copy and redistribute the material in any medium or format
text remix transform : adapt remix transform and build upon the material for any purpose even commercially
hint creative commons : (?:a )?creative commons licen[sc]e
= pddl-1.0
title public dedication : public domain dedication and licen[sc]e
spdx pddl : {TAG}pddl 1 0
= odbl-1.0
text database distribute : you are free to share to copy distribute and use the database
title open database : open database licen[sc]e(?: odbl)?(?: {VERSION}1(?: 0)?)?
spdx odbl : {TAG}odbl 1 0
url opendatacommons odbl : opendatacommons org licenses odbl
= odc-by-1.0
title open data attribution : open data commons attribution licen[sc]e
spdx odc by : {TAG}odc by 1 0
url opendatacommons by : opendatacommons org licenses by
= gfdl-1.2
text gnu documentation modify : modify this document under the terms of the gnu free documentation license version 1 2
title gnu documentation : gnu free documentation licen[sc]e {VERSION}1 2
spdx gfdl : {TAG}gfdl 1 2(?: only| or later)?
= gfdl-1.3
text gnu documentation modify : modify this document under the terms of the gnu free documentation license version 1 3
title gnu documentation : gnu free documentation licen[sc]e {VERSION}1 3
spdx gfdl : {TAG}gfdl 1 3(?: only| or later)?
= gfdl
text gnu documentation modify : modify this document under the terms of the gnu free documentation license
grant gnu documentation : {GRANT}gnu free documentation licen[sc]e
title gnu documentation : gnu free documentation licen[sc]e
title gfdl : gfdl
= ms-pl
title microsoft public : microsoft public licen[sc]e(?: ms pl)?
spdx ms pl : {TAG}ms pl
= ms-rl
title microsoft reciprocal : microsoft reciprocal licen[sc]e(?: ms rl)?
spdx ms rl : {TAG}ms rl
= eupl-1.1
title european union : european union public licen[sc]e {VERSION}1 1
spdx eupl : {TAG}eupl 1 1
= eupl-1.2
grant eupl : {GRANT}eupl(?: {VERSION}1 2)?
title european union : european union public licen[sc]e(?: {VERSION}1 2)?
spdx eupl : {TAG}eupl 1 2
= osl-3.0
title open software : open software licen[sc]e(?: {VERSION}3(?: 0)?)?
tag osl : {TAG}osl 3 0
= afl-3.0
title academic free : academic free licen[sc]e(?: {VERSION}3(?: 0)?)?
tag afl : {TAG}afl 3 0
= ofl-1.1
text font components sold : neither the font software nor any of its individual components in original or modified versions may be sold by itself
text ofl fonts studied : the ofl allows the licensed fonts to be used studied modified and redistributed freely as long as they are not sold by themselves
grant sil : {GRANT}sil open font licen[sc]e(?: {VERSION}1 1)?
title sil font : sil open font licen[sc]e(?: {VERSION}1 1)?
spdx ofl : {TAG}ofl 1 1
url scripts sil ofl : scripts sil org ofl
= ncsa
text deal restriction : to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
title illinois ncsa : university of illinois ncsa open source licen[sc]e
tag ncsa : {TAG}ncsa
= postgresql
text fee agreement documentation : permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
grant postgresql : {GRANT}postgresql licen[sc]e
title postgresql : postgresql licen[sc]e
tag postgresql : {TAG}postgresql
= openssl
title openssl : openssl licen[sc]e
text openssl toolkit : this product includes software developed by the openssl project for use in the openssl toolkit
= ssleay
text cryptographic eric : this product includes cryptographic software written by eric young
= curl
title curl : curl licen[sc]e
tag curl : {TAG}curl
= x11
text advertising promote sale : except as contained in this notice the name (?:of )?(?:the )?(?:[^ ]+ ){1,6}?shall not be used in advertising or otherwise to promote the sale
title x11 : x11 licen[sc]e
tag x11 : {TAG}x11
= imagemagick
title imagemagick : imagemagick licen[sc]e
= vim
text vim maintainer : if you distribute a modified version of vim you are encouraged to send the maintainer a copy
title vim : vim licen[sc]e
tag vim : {TAG}vim
= w3c
text licensee understood comply : by obtaining and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions
title w3c : w3c software (?:notice and )?(?:document )?licen[sc]e
tag w3c : {TAG}w3c
= unicode
title unicode : unicode (?:inc )?licen[sc]e agreement
tag unicode : {TAG}unicode (?:dfs 2016|3 0)
= upl-1.0
text condition obtaining documentation : subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
title universal permissive : universal permissive licen[sc]e(?: {VERSION}1(?: 0)?)?
spdx upl : {TAG}upl 1 0
= blueoak-1.0.0
text everyone protecting : this license gives everyone as much permission to work with this software as possible while protecting contributors from liability
title blue oak : blue oak model licen[sc]e
spdx blueoak : {TAG}blueoak 1 0 0
= mulan-psl-2.0
text mulan psl : you can use this software according to the terms and conditions of the mulan psl v2
title mulan : mulan permissive software licen[sc]e(?: {VERSION}2)?
spdx mulanpsl : {TAG}mulanpsl 2 0
= cecill
text cecill french : this software is governed by the cecill(?: [abc])? license under french law and abiding by the rules of distribution of free software
title cecill : cecill(?: [abc])? (?:free software )?licen[sc]e
tag cecill : {TAG}cecill(?: [bc]| 2 1)?
= qpl-1.0
title q public : q public licen[sc]e
spdx qpl : {TAG}qpl 1 0
= sleepycat
title sleepycat : sleepycat licen[sc]e
= sspl-1.0
text functionality service parties : if you make the functionality of the program or a modified version available to third parties as a service
grant side public : {GRANT}server side public licen[sc]e
title side public : server side public licen[sc]e(?: {VERSION}1)?
spdx sspl : {TAG}sspl 1 0
= bsl-1.1
text licensor production : the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
grant business source : {GRANT}business source licen[sc]e
title business source : business source licen[sc]e(?: {VERSION}1 1)?
spdx busl : {TAG}busl 1 1
= elastic-2.0
text hosted managed : you may not provide the software to third parties as a hosted or managed service
grant elastic : {GRANT}elastic licen[sc]e(?: {VERSION}2(?: 0)?)?
title elastic : elastic licen[sc]e(?: {VERSION}2(?: 0)?)?
tag elastic : {TAG}elastic 2 0
= commons-clause
text sell grant : the license does not grant to you the right to sell the software
title commons clause : commons clause(?: licen[sc]e)?(?: condition)?
= polyform
text licensor infringe : the licensor grants you a copyright license for the software to do everything you might do with the software that would otherwise infringe
title polyform : polyform (?:noncommercial|small business|shield|perimeter) licen[sc]e
= openrail
text model derivatives agree : you agree not to use the model or derivatives of the model
title openrail|rail : (?:creativeml )?(?:bigscience )?open ?rail(?: [ms]| m)? licen[sc]e
tag openrail : {TAG}openrail
= llama
text meta exclusive transferable : you are granted a non exclusive worldwide non transferable and royalty free limited license under meta s intellectual property
title llama community : llama (?:[23](?: [0-9])? )?community licen[sc]e(?: agreement)?
= public-domain
grant public domain : (?:released|placed|dedicated|is) (?:in|into|to) the public domain
hint public domain : in the public domain
= json
text good evil : the software shall be used for good not evil
tag json : {TAG}json
= beerware
text retain notice whatever stuff : as long as you retain this notice you can do whatever you want with this stuff
text beer return : you can buy me a beer in return
title beer|beerware : (?:the )?beer ?ware licen[sc]e
= 0bsd
tag 0bsd : {TAG}0bsd
id 0bsd or|and : {BESIDE 0bsd}
title zero clause bsd : zero clause bsd(?: licen[sc]e)?
title bsd clause : bsd zero clause(?: licen[sc]e)?
= hpnd
text fee supporting : permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
= bitstream-vera
text font typefaces sold : the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
= eupl
text european eupl applies : this european union public licence the eupl applies to the work
= classpath-exception-2.0
id classpath exception : (?:with )?classpath exception(?: 2 0)?
text linking statically combined : linking this library statically or dynamically with other modules is making a combined work based on this library
= llvm-exception
id llvm exception|exceptions : (?:with )?llvm exceptions?
= proprietary
text trade secrets : (?:contains|contain) (?:the )?(?:confidential information and )?trade secrets (?:and confidential information )?of
grant rights reserved : all rights reserved
text confidential proprietary : confidential and proprietary(?: information)?
text prohibited unauthorized : unauthorized (?:copying|reproduction|use|distribution)(?: of this file)?[ a-z]{0,40} is (?:strictly )?prohibited
hint permission without : may not be reproduced[ a-z]{0,60} without (?:the )?(?:prior )?(?:written )?permission
= unknown-license
hint terms subject : subject to the terms (?:and conditions )?of (?:the|this) licen[sc]e
hint license|licence agreement : end user licen[sc]e agreement
hint licensed|licenced under : licen[sc]ed under (?:the|an?) [^ ]+ licen[sc]e
"""


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    confidence: float
    #: Of each of these sets of words, a text must have one: those that any spelling has, then others.
    keywords: tuple[frozenset[bytes], ...]
    context: tuple[frozenset[bytes], ...]
    pattern: re.Pattern


def beside(word: str) -> str:
    """``word`` as one side of an expression, whose other side is an identifier."""
    ends = "|".join(f"(?<= {end} {how} )" for end in ENDS for how in ("or", "and"))
    return f"{word}(?= (?:or|and) {IDS} )|(?:{ends}){word}"


def compile_rules(signatures: str = SIGNATURES) -> list[Rule]:
    """The rules of a table, in its order; patterns match whole words of the joined text."""
    rules, label = [], ""
    for line in signatures.strip().splitlines():
        if line.startswith("= "):
            label = line[2:].strip()
            continue
        head, pattern = line.split(" : ", 1)
        kind, *keywords = head.split()
        words = lambda some: tuple(frozenset(k.lstrip("+").encode().split(b"|")) for k in some)
        own, other = words(k for k in keywords if k[0] != "+"), words(k for k in keywords if k[0] == "+")
        for kind, start in (("tag", TAG), ("id", "")) if kind == "spdx" else ((kind, TAG),):
            priority, confidence = KINDS[kind]
            spelt = re.sub(r"\{BESIDE (\w+)\}", lambda m: beside(m[1]), pattern)
            for name, part in (("GRANT", GRANT), ("TAG", start), ("VERSION", VERSION)):
                spelt = spelt.replace("{" + name + "}", part)
            rules.append(Rule(f"{label}/{kind}/{len(rules)}", label, priority, confidence, own, other, re.compile(f"(?<= )(?:{spelt})(?= )".encode())))
    return rules


def base_rules(phrases: dict[str, str] = BASE_PHRASES) -> list[Rule]:
    """A rule of highest priority for each phrase, found by its words alone."""
    return [
        Rule(f"base/{label}", label, 0, 1.0, tuple(frozenset([w]) for w in phrase.encode().split()), (), re.compile(f"(?<= )(?:{re.escape(phrase)})(?= )".encode()))
        for phrase, label in phrases.items()
    ]
