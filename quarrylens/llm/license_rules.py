"""Signature rules of license_scan, written by hand.

Each line: label, priority, keyword, expression.  Expressions are matched on a text's words (A-Z
in lower case, letters, digits and all beyond ASCII), joined by one space, and only at ends of
words.  The keyword is a word that every match holds; a rule is tried only where it occurs.

Short forms: <3> is a version (``3``, ``3 0``, ``v3``, ``version 3``), <2.1> one with a minor
number, LIC is license or licence, OF introduces a grant (``licensed under the terms of the``),
SPDX the words of a tag.  Priorities: 95 tag, 90 sentence of the license itself, 80 grant that
names it, 70 full name with version, 60 full name or address, 50 short name, 30 weaker notice.
"""

from __future__ import annotations

import re

#: The base: phrase and label, fixed by the contract of the query.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

RULES = r"""
mit 95 mit SPDX mit
mit 90 permission permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 80 mit OF mit(?: LIC)?
mit 60 mit (?:the )?mit LIC
mit 60 mit opensource org licenses? mit
mit 60 mit LIC mit
mit 50 mit mit licensed
mit 50 expat (?:the )?expat LIC
mit-0 95 mit SPDX mit 0
mit-0 70 mit mit no attribution(?: LIC)?
x11 95 x11 SPDX x11
x11 60 x11 (?:the )?x11 LIC
x11 60 mit mit x11(?: LIC)?
isc 95 isc SPDX isc
isc 90 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 80 isc OF isc LIC
isc 60 isc (?:the )?isc LIC
0bsd 95 0bsd SPDX 0bsd
0bsd 60 bsd (?:zero clause bsd|bsd zero clause|0 clause bsd)(?: LIC)?
bsd-2-clause 95 bsd SPDX bsd 2 clause
bsd-2-clause 80 bsd OF (?:bsd 2 clause|2 clause bsd|simplified bsd)(?: LIC)?
bsd-2-clause 80 freebsd OF freebsd LIC
bsd-2-clause 70 bsd (?:bsd 2 clause|2 clause bsd|two clause bsd)(?: LIC)?
bsd-2-clause 60 bsd simplified bsd LIC
bsd-2-clause 60 freebsd freebsd LIC
bsd-3-clause 95 bsd SPDX bsd 3 clause
bsd-3-clause 90 endorse neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products
bsd-3-clause 80 bsd OF (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: LIC)?
bsd-3-clause 70 bsd (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: LIC)?
bsd-3-clause 60 bsd (?:new|modified|revised) bsd LIC
bsd-3-clause-clear 95 bsd SPDX bsd 3 clause clear
bsd-3-clause-clear 60 bsd clear bsd LIC
bsd-4-clause 95 bsd SPDX bsd 4 clause
bsd-4-clause 90 advertising all advertising materials mentioning features or use of this software must display
bsd-4-clause 70 bsd (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: LIC)?
bsd 90 redistribution redistribution and use in source and binary forms with or without modification are permitted
bsd 80 bsd OF bsd(?: style)? LIC
bsd 60 bsd (?:the )?bsd(?: style)? LIC
bsd 50 bsd bsd licensed
apache-2.0 95 apache SPDX apache 2 0
apache-2.0 90 apache you may not use this file except in compliance with the LIC (?:.{0,60} )?apache org licenses LIC 2 0
apache-2.0 80 apache OF apache LIC <2>
apache-2.0 80 apache OF apache <2>(?: LIC)?
apache-2.0 70 apache (?:the )?apache(?: software)? LIC <2>
apache-2.0 60 apache apache org licenses LIC 2 0(?: txt| html)?
apache-2.0 60 asl asl <2.0>
apache-2.0 50 apache apache(?: LIC)? 2 0
apache-1.1 95 apache SPDX apache 1 1
apache-1.1 70 apache apache(?: software)? LIC <1.1>
apache-1.0 95 apache SPDX apache 1 0
apache-1.0 70 apache apache(?: software)? LIC <1.0>
apache 80 apache OF apache(?: software)? LIC
apache 60 apache (?:the )?apache software LIC
apache 50 apache apache(?: software foundation)? licensed
gpl-1.0 95 gpl SPDX gpl 1 0(?: only| or later)?
gpl-1.0 70 gnu gnu general public LIC <1>
gpl-2.0 95 gpl SPDX gpl 2 0 only
gpl-2.0 95 gpl SPDX gpl 2 0
gpl-2.0 80 gnu OF gnu general public LIC <2>
gpl-2.0 80 gnu gnu general public LIC(?: gpl)? as published by the free software foundation (?:either )?<2>
gpl-2.0 70 gnu (?:the )?gnu general public LIC <2>
gpl-2.0 70 gnu (?:the )?gnu gpl <2>
gpl-2.0 60 gpl2 gpl2
gpl-2.0 60 gplv2 (?:gnu )?gplv2
gpl-2.0 60 gpl (?:the )?gpl <2>
gpl-2.0-or-later 95 gpl SPDX gpl 2 0 or later
gpl-2.0-or-later 85 gnu gnu general public LIC(?: gpl)? as published by the free software foundation (?:either )?<2> of the LIC or at your option any later version
gpl-2.0-or-later 85 later gnu general public LIC <2> or(?: any)? later(?: version)?
gpl-2.0-or-later 70 later (?:gplv2|gpl <2>) or(?: any)? later(?: version)?
gpl-3.0 95 gpl SPDX gpl 3 0 only
gpl-3.0 95 gpl SPDX gpl 3 0
gpl-3.0 80 gnu OF gnu general public LIC <3>
gpl-3.0 80 gnu gnu general public LIC(?: gpl)? as published by the free software foundation (?:either )?<3>
gpl-3.0 70 gnu (?:the )?gnu general public LIC <3>
gpl-3.0 70 gnu (?:the )?gnu gpl <3>
gpl-3.0 60 gpl3 gpl3
gpl-3.0 60 gplv3 (?:gnu )?gplv3
gpl-3.0 60 gpl (?:the )?gpl <3>
gpl-3.0 60 gpl gnu org licenses gpl 3 0(?: html| txt)?
gpl-3.0-or-later 95 gpl SPDX gpl 3 0 or later
gpl-3.0-or-later 85 gnu gnu general public LIC(?: gpl)? as published by the free software foundation (?:either )?<3> of the LIC or at your option any later version
gpl-3.0-or-later 85 later gnu general public LIC <3> or(?: any)? later(?: version)?
gpl-3.0-or-later 70 later (?:gplv3|gpl <3>) or(?: any)? later(?: version)?
gpl-with-exception 85 classpath (?:gpl|gnu general public LIC)(?: <2>)? with(?: the)? classpath exception
gpl-with-exception 85 exception gcc runtime library exception
gpl-with-exception 85 exception (?:gpl|gnu general public LIC)(?: <[23]>)? with (?:autoconf|bison|font|linking|openssl) exception
gpl 80 gnu OF gnu general public LIC
gpl 80 gpl OF (?:gnu )?gpl(?: LIC)?
gpl 60 gnu (?:the )?gnu general public LIC
gpl 60 gpl gnu org licenses gpl(?: html| txt)?
gpl 50 gpl (?:gnu gpl|gpl LIC|gpl licensed)
lgpl-2.0 95 lgpl SPDX lgpl 2 0(?: only| or later)?
lgpl-2.0 70 gnu gnu library general public LIC(?: <2>)?
lgpl-2.1 95 lgpl SPDX lgpl 2 1(?: only| or later)?
lgpl-2.1 80 gnu OF gnu lesser general public LIC <2.1>
lgpl-2.1 70 gnu gnu lesser general public LIC <2.1>
lgpl-2.1 60 lgpl (?:gnu )?lgpl <2.1>
lgpl-2.1 60 lgplv2 lgplv2(?: 1)?
lgpl-2.1-or-later 85 gnu gnu lesser general public LIC as published by the free software foundation either <2.1> of the LIC or at your option any later version
lgpl-3.0 95 lgpl SPDX lgpl 3 0(?: only| or later)?
lgpl-3.0 80 gnu OF gnu lesser general public LIC <3>
lgpl-3.0 70 gnu gnu lesser general public LIC <3>
lgpl-3.0 60 lgpl (?:gnu )?lgpl <3>
lgpl-3.0 60 lgplv3 lgplv3
lgpl-3.0-or-later 85 gnu gnu lesser general public LIC as published by the free software foundation either <3> of the LIC or at your option any later version
lgpl 80 lgpl OF (?:gnu )?lgpl
lgpl 60 gnu (?:the )?gnu (?:lesser|library) general public LIC
lgpl 50 lgpl (?:gnu lgpl|lgpl LIC|lgpl licensed)
agpl-3.0 95 agpl SPDX agpl 3 0(?: only| or later)?
agpl-3.0 80 affero OF gnu affero general public LIC <3>
agpl-3.0 70 affero gnu affero general public LIC <3>
agpl-3.0 60 agpl (?:gnu )?agpl <3>
agpl-3.0 60 agplv3 agplv3
agpl-1.0 70 affero affero general public LIC <1>
agpl 60 affero (?:gnu )?affero general public LIC
agpl 50 agpl (?:gnu agpl|agpl LIC|agpl licensed)
gfdl-1.1 95 gfdl SPDX gfdl 1 1(?: only| or later)?
gfdl-1.2 95 gfdl SPDX gfdl 1 2(?: only| or later)?
gfdl-1.3 95 gfdl SPDX gfdl 1 3(?: only| or later)?
gfdl-1.1 70 documentation gnu free documentation LIC <1.1>
gfdl-1.2 70 documentation gnu free documentation LIC <1.2>
gfdl-1.3 70 documentation gnu free documentation LIC <1.3>
gfdl 60 documentation (?:the )?gnu free documentation LIC
gfdl 50 gfdl (?:gnu )?gfdl
mpl-1.0 95 mpl SPDX mpl 1 0
mpl-1.0 70 mozilla mozilla public LIC <1.0>
mpl-1.1 95 mpl SPDX mpl 1 1
mpl-1.1 90 mozilla the contents of this file are subject to the mozilla public LIC <1.1>
mpl-1.1 70 mozilla mozilla public LIC <1.1>
mpl-1.1 60 mpl mpl <1.1>
mpl-2.0 95 mpl SPDX mpl 2 0
mpl-2.0 90 mozilla this source code form is subject to the terms of the mozilla public LIC v 2 0
mpl-2.0 80 mozilla OF mozilla public LIC <2>
mpl-2.0 70 mozilla mozilla public LIC <2>
mpl-2.0 60 mpl mpl <2>
mpl-2.0 60 mozilla mozilla org mpl 2 0
mpl 60 mozilla (?:the )?mozilla public LIC
epl-1.0 95 epl SPDX epl 1 0
epl-1.0 70 eclipse eclipse public LIC <1>
epl-1.0 60 eclipse eclipse org legal epl v10(?: html)?
epl-2.0 95 epl SPDX epl 2 0
epl-2.0 70 eclipse eclipse public LIC <2>
epl-2.0 60 eclipse eclipse org legal epl (?:2 0|v20)(?: html)?
epl 60 eclipse (?:the )?eclipse public LIC
edl-1.0 60 eclipse eclipse distribution LIC(?: <1>)?
eupl-1.1 95 eupl SPDX eupl 1 1
eupl-1.1 70 european european union public LIC <1.1>
eupl-1.1 60 eupl eupl <1.1>
eupl-1.2 95 eupl SPDX eupl 1 2
eupl-1.2 70 european european union public LIC <1.2>
eupl-1.2 60 eupl eupl <1.2>
eupl 60 european (?:the )?european union public LIC
cddl-1.0 95 cddl SPDX cddl 1 0
cddl-1.0 70 cddl (?:common development and distribution LIC )?cddl <1.0>
cddl-1.1 95 cddl SPDX cddl 1 1
cddl-1.1 70 cddl (?:common development and distribution LIC )?cddl <1.1>
cddl 60 distribution common development and distribution LIC
cpl-1.0 95 cpl SPDX cpl 1 0
cpl-1.0 60 common (?:the )?common public LIC(?: <1>)?
cpal-1.0 95 cpal SPDX cpal 1 0
cpal-1.0 60 attribution common public attribution LIC(?: <1>)?
ipl-1.0 60 ibm ibm public LIC(?: <1>)?
artistic-1.0 95 artistic SPDX artistic 1 0
artistic-1.0 70 artistic artistic LIC <1>
artistic-2.0 95 artistic SPDX artistic 2 0
artistic-2.0 70 artistic artistic LIC <2>
artistic 60 artistic (?:the )?artistic LIC
perl 70 perl (?:same terms as perl itself|under the same terms as perl)
bsl-1.0 95 bsl SPDX bsl 1 0
bsl-1.0 70 boost boost software LIC(?: <1>)?
bsl-1.0 60 boost boost org LIC 1 0(?: txt)?
busl-1.1 95 busl SPDX busl 1 1
busl-1.1 60 business (?:the )?business source LIC(?: <1.1>)?
sspl-1.0 95 sspl SPDX sspl 1 0
sspl-1.0 60 server (?:the )?server side public LIC(?: <1>)?
elastic-2.0 95 elastic SPDX elastic 2 0
elastic-2.0 60 elastic (?:the )?elastic LIC(?: <2>)?
commons-clause 60 commons commons clause(?: LIC condition)?
confluent 60 confluent confluent community LIC
zlib 95 zlib SPDX zlib
zlib 90 warranty this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 60 zlib (?:the )?zlib(?: libpng)? LIC
libpng 95 libpng SPDX libpng(?: 2 0)?
libpng 60 libpng (?:the )?libpng LIC
unlicense 95 unlicense SPDX unlicense
unlicense 90 unencumbered this is free and unencumbered software released into the public domain
unlicense 60 unlicense (?:the unlicense|OF unlicense)
unlicense 60 unlicense unlicense org
wtfpl 95 wtfpl SPDX wtfpl
wtfpl 90 public do what the fuck you want to public LIC
wtfpl 50 wtfpl wtfpl
beerware 60 beer the beer ware LIC
beerware 50 beerware beerware(?: LIC)?
psf-2.0 95 psf SPDX psf 2 0
psf-2.0 95 python SPDX python 2 0
psf-2.0 60 python python software foundation LIC(?: <2>)?
psf-2.0 50 psf psf LIC
cnri-python 60 cnri cnri(?: open source)?(?: gpl compatible)? LIC agreement
ruby 95 ruby SPDX ruby
ruby 60 ruby (?:the )?ruby LIC
php-3.01 95 php SPDX php 3 0?1
php-3.01 60 php (?:the )?php LIC(?: <3.01>)?
zend-2.0 60 zend (?:the )?zend(?: engine)? LIC
openssl 95 openssl SPDX openssl
openssl 90 openssl this product includes software developed by the openssl project
openssl 60 openssl (?:the )?openssl LIC
ssleay 60 ssleay original ssleay LIC
curl 95 curl SPDX curl
curl 60 curl (?:the )?curl LIC
ncsa 95 ncsa SPDX ncsa
ncsa 60 ncsa (?:university of illinois )?ncsa open source LIC
postgresql 95 postgresql SPDX postgresql
postgresql 60 postgresql (?:the )?postgresql LIC
upl-1.0 95 upl SPDX upl 1 0
upl-1.0 60 universal universal permissive LIC(?: <1>)?
afl-3.0 95 afl SPDX afl 3 0
afl-3.0 60 academic academic free LIC(?: <3>)?
osl-3.0 95 osl SPDX osl 3 0
osl-3.0 60 open open software LIC <3>
ecl-2.0 95 ecl SPDX ecl 2 0
ecl-2.0 60 educational educational community LIC(?: <2>)?
ms-pl 95 ms SPDX ms pl
ms-pl 60 microsoft microsoft public LIC
ms-rl 95 ms SPDX ms rl
ms-rl 60 microsoft microsoft reciprocal LIC
w3c 95 w3c SPDX w3c
w3c 60 w3c w3c(?: r)? software(?: notice)?(?: and(?: document)?)? LIC
unicode 95 unicode SPDX unicode (?:dfs 2015|dfs 2016|3 0)
unicode 60 unicode unicode(?: inc)? LIC(?: agreement| v3)?
icu 60 icu (?:the )?icu LIC
ofl-1.1 95 ofl SPDX ofl 1 1
ofl-1.1 60 sil sil open font LIC(?: <1.1>)?
ofl-1.1 60 ofl scripts sil org ofl
bitstream-vera 60 bitstream bitstream vera(?: fonts?)?(?: LIC| copyright)
lppl-1.3c 95 lppl SPDX lppl 1 3[ac]
lppl-1.3c 60 latex latex project public LIC(?: <1.3>c?)?
qpl-1.0 95 qpl SPDX qpl 1 0
qpl-1.0 60 q (?:the )?q public LIC
sleepycat 60 sleepycat (?:the )?sleepycat LIC
tcl 60 tcl tcl tk LIC
vim 60 vim (?:the )?vim LIC
json 90 evil the software shall be used for good not evil
hippocratic 60 hippocratic hippocratic LIC
mulanpsl-2.0 95 mulanpsl SPDX mulanpsl 2 0
mulanpsl-2.0 60 mulan mulan permissive software LIC(?: <2>)?
blueoak-1.0.0 95 blueoak SPDX blueoak 1 0 0
blueoak-1.0.0 60 oak blue oak model LIC(?: 1 0 0)?
cecill-2.1 95 cecill SPDX cecill 2 1
cecill-2.1 70 cecill cecill <2.1>
cecill-b 60 cecill cecill b(?: LIC)?
cecill-c 60 cecill cecill c(?: LIC)?
cecill 50 cecill cecill(?: free software)? LIC
etalab-2.0 60 etalab (?:licence ouverte|open licence)(?: open licence)? etalab(?: 2 0)?
cc0-1.0 95 cc0 SPDX cc0 1 0
cc0-1.0 70 cc0 cc0(?: 1 0)? universal
cc0-1.0 60 publicdomain creativecommons org publicdomain zero 1 0(?: legalcode)?
cc0-1.0 50 cc0 cc0(?: LIC| 1 0)?
cc-pdm-1.0 60 publicdomain creativecommons org publicdomain mark 1 0
cc-by-1.0 70 cc cc by 1 0
cc-by-2.0 70 cc cc by 2 0
cc-by-2.5 70 cc cc by 2 5
cc-by-3.0 70 cc cc by 3 0
cc-by-4.0 70 cc cc by 4 0
cc-by-4.0 60 creativecommons creativecommons org licenses by 4 0(?: legalcode)?
cc-by-4.0 70 attribution creative commons attribution 4 0(?: international)?(?: public)?(?: LIC)?
cc-by-sa-2.5 70 sa cc by sa 2 5
cc-by-sa-3.0 70 sa cc by sa 3 0
cc-by-sa-3.0 60 sa creativecommons org licenses by sa 3 0(?: legalcode)?
cc-by-sa-4.0 70 sa cc by sa 4 0
cc-by-sa-4.0 60 sa creativecommons org licenses by sa 4 0(?: legalcode)?
cc-by-sa-4.0 70 sharealike creative commons attribution sharealike 4 0(?: international)?(?: public)?(?: LIC)?
cc-by-sa 65 sa cc by sa
cc-by-sa 65 sharealike creative commons attribution sharealike
cc-by-sa 65 alike creative commons attribution share alike
cc-by-nc-2.0 70 nc cc by nc 2 0
cc-by-nc-3.0 70 nc cc by nc 3 0
cc-by-nc-4.0 70 nc cc by nc 4 0
cc-by-nc-4.0 60 nc creativecommons org licenses by nc 4 0(?: legalcode)?
cc-by-nc-4.0 70 noncommercial creative commons attribution noncommercial 4 0(?: international)?(?: public)?(?: LIC)?
cc-by-nc 65 nc cc by nc
cc-by-nc-sa-3.0 70 nc cc by nc sa 3 0
cc-by-nc-sa-4.0 70 nc cc by nc sa 4 0
cc-by-nc-sa-4.0 60 nc creativecommons org licenses by nc sa 4 0(?: legalcode)?
cc-by-nc-sa 66 nc cc by nc sa
cc-by-nc-nd-3.0 70 nc cc by nc nd 3 0
cc-by-nc-nd-4.0 70 nc cc by nc nd 4 0
cc-by-nc-nd-4.0 60 nc creativecommons org licenses by nc nd 4 0(?: legalcode)?
cc-by-nc-nd 66 nc cc by nc nd
cc-by-nd-3.0 70 nd cc by nd 3 0
cc-by-nd-4.0 70 nd cc by nd 4 0
cc-by-nd-4.0 60 nd creativecommons org licenses by nd 4 0(?: legalcode)?
cc-by-nd 65 nd cc by nd
cc-by 60 attribution creative commons attribution(?: LIC)?
cc 50 creative (?:a )?creative commons LIC
cc 50 creativecommons creativecommons org licenses?
odc-by-1.0 95 odc SPDX odc by 1 0
odc-by-1.0 60 attribution open data commons attribution LIC(?: <1.0>)?
odbl-1.0 95 odbl SPDX odbl 1 0
odbl-1.0 60 database open(?: data commons)? (?:open )?database LIC(?: <1.0>)?
odbl-1.0 50 odbl odbl
pddl-1.0 95 pddl SPDX pddl 1 0
pddl-1.0 60 dedication public domain dedication and LIC
cdla-permissive-2.0 60 data community data LIC agreement permissive(?: <2.0>)?
cdla-sharing-1.0 60 data community data LIC agreement sharing(?: <1.0>)?
ogl-uk-3.0 60 government (?:the )?open government LIC(?: <3.0>)?
openrail 60 rail (?:creativeml )?open rail(?: m)?(?: LIC)?
openrail 60 openrail (?:creativeml |bigscience )?openrail(?: m)?(?: LIC)?
llama 60 llama llama(?: 2| 3)?(?: 1)? community LIC(?: agreement)?
public-domain 60 public (?:dedicated to|released (?:in|into|to)|placed (?:in|into)|is in) the public domain
proprietary 80 proprietary (?:proprietary and confidential|confidential and proprietary)
proprietary 70 prohibited unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|work) (?:.{0,60} )?prohibited
proprietary 60 eula (?:end user LIC agreement eula|eula)
proprietary 60 agreement end user LIC agreement
all-rights-reserved 30 reserved all rights reserved
non-commercial 60 commercial for non commercial (?:use|purposes)(?: only)?
non-commercial 60 noncommercial for noncommercial (?:use|purposes)(?: only)?
dual-license 40 dual (?:is )?dual licensed(?: under)?
unknown-license 30 for (?:see|refer to)(?: the)?(?: accompanying| file)? LIC(?: md| txt)?(?: file)? for (?:details|more information|the full LIC text|LIC information)
unknown-license 30 licensed licensed under the terms (?:of the|found in the|described in the) LIC(?: file)?
unknown-license 30 spdx SPDX licenseref \S+
"""


def expanded(expression: str) -> str:
    """An expression with its short forms written out."""
    out = re.sub(r"<(\d)\.(\d+)>", r"(?:version |v ?)?\1 \2", expression)
    out = re.sub(r"<(\d|\[\d+\])>", r"(?:version |v ?)?\1(?: 0)?", out)
    out = out.replace("OF ", r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered) (?:under|by|with)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: a)? ")
    return out.replace("SPDX", r"spdx licen[cs]e identifier").replace("LIC", r"licen[cs]e")


def parsed() -> list[tuple[str, int, str, str]]:
    """label, priority, keyword, expanded expression of every rule, in order."""
    lines = (line.split(None, 3) for line in RULES.strip().split("\n"))
    return [(label, int(priority), keyword, expanded(expression)) for label, priority, keyword, expression in lines]
