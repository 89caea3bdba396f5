"""Signatures written out from the wording of notices and clauses.

A line is priority, label, pattern: words in lower case without punctuation, one space between them, with @
before the word that must stand in a text for the rule to be tried. `(?: ...)?` marks words that may be left
out, `(?:a|b)` either of two. Lines of one licence stand together.
"""

from __future__ import annotations

import re

#: The wording of public licences.
WORDING = """
60 mit permission is hereby @granted free of charge to any person obtaining a copy
60 mit to deal in the software without @restriction including without limitation the rights
60 mit this permission notice shall be included in all copies or substantial @portions of the software
60 mit authors or copyright holders be @liable for any claim damages or other liability
58 mit the software is provided as is without @warranty of any kind express or implied including but not limited to the warranties of merchantability
60 mit-0 permission is hereby @granted free of charge to any person obtaining a copy of this software and associated documentation files without restriction
60 x11 except as contained in this notice the name of the x @consortium shall not be used in advertising
60 isc permission to use copy modify and (?:or )?@distribute this software for any purpose with or without fee is hereby granted
60 isc the author @disclaims all warranties with regard to this software
60 0bsd permission to use copy modify and or @distribute this software for any purpose with or without fee is hereby granted the software is provided as is
60 hpnd permission to use copy modify (?:and )?distribute (?:and sell )?this software and its @documentation for any purpose
60 bsd redistribution and use in source and binary forms with or without @modification are permitted
60 bsd redistributions of source code must @retain the above copyright notice
60 bsd redistributions in binary form must @reproduce the above copyright notice
60 bsd-3-clause nor the names of its @contributors may be used to endorse or promote products
60 bsd-3-clause may not be used to @endorse or promote products derived from this software without specific prior written permission
62 bsd-4-clause all advertising @materials mentioning features or use of this software must display the following acknowledgement
58 bsd this software is provided by the (?:copyright holders|regents|author)(?: and contributors)? as is and any express or implied @warranties
60 bsd-2-clause-patent subject to the terms and conditions of this license each copyright holder and @contributor hereby grants to those receiving rights
60 bsd-3-clause-clear no express or implied @licenses to any partys patent rights are granted by this license
60 apache-2.0 licensed under the @apache license version 2 0 the license
60 apache-2.0 you may not use this file except in @compliance with the license
60 apache-2.0 unless required by applicable law or agreed to in @writing software distributed under the license is distributed on an as is basis
60 apache-2.0 subject to the terms and conditions of this license each contributor hereby grants to you a @perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
62 apache-1.1 this product includes software developed by the @apache software foundation
60 apache-1.1 products derived from this software may not be called @apache
60 gpl as published by the free software @foundation either version
62 gpl-2.0 gnu general public license as published by the free software @foundation either version 2 of the license or
62 gpl-3.0 gnu general public license as published by the free software @foundation either version 3 of the license or
62 gpl-1.0 gnu general public license as published by the free software @foundation either version 1 or
63 gpl-2.0-only gnu general public license version 2 (?:only )?as published by the free software @foundation
60 gpl you should have received a copy of the gnu general public license along with this @program
58 gpl this program is distributed in the hope that it will be useful but without any @warranty
60 gpl if not write to the free software @foundation inc
60 gpl this program is free software you can @redistribute it and or modify it
60 gpl activities other than copying @distribution and modification are not covered by this license
60 gpl you may copy and distribute @verbatim copies of the programs source code
62 gpl-3.0 the gnu general public license is a free @copyleft license for software and other kinds of works
62 gpl-3.0 no covered work shall be deemed part of an effective technological @measure
60 gpl-cc-1.0 gpl cooperation @commitment
62 gpl-linking-exception linking this library statically or dynamically with other modules is making a @combined work
62 classpath-exception as a special @exception the copyright holders of this library give you permission to link this library with independent modules
62 classpath-exception gnu classpath @exception
62 gcc-exception gcc runtime library @exception
62 bison-exception as a special @exception you may create a larger work that contains part or all of the bison parser skeleton
62 autoconf-exception as a special exception to the gnu general public license if you @distribute this file as part of a program that contains a configuration script
62 font-exception if you create a document which uses this font and @embed this font
62 openssl-exception as a special @exception the copyright holders give permission to link the code of portions of this program with the openssl library
62 linux-syscall-note does not cover user programs that use kernel @services by normal system calls
62 lgpl-2.1 gnu lesser general public license as published by the free software @foundation either version 2 1 of the license or
62 lgpl-3.0 gnu lesser general public license as published by the free software @foundation either version 3 of the license or
62 lgpl-2.0 gnu library general public license as published by the free software @foundation either version 2 of the license or
60 lgpl you should have received a copy of the gnu (?:lesser|library) general public license along with this @library
60 lgpl this library is free software you can @redistribute it and or modify it
60 lgpl a program that contains no @derivative of any portion of the library but is designed to work with the library
62 agpl-3.0 gnu affero general public license as published by the free software @foundation either version 3 of the license or
60 agpl you should have received a copy of the gnu @affero general public license
60 agpl if you modify the program your modified version must prominently offer all users @interacting with it remotely through a computer network
60 gfdl permission is granted to copy distribute and or modify this document under the terms of the gnu free @documentation license
60 gfdl with no @invariant sections no front cover texts and no back cover texts
62 mpl-2.0 this source code form is subject to the terms of the @mozilla public license v 2 0
60 mpl-2.0 if a copy of the mpl was not distributed with this file you can obtain one at (?:http|https) @mozilla org mpl 2 0
62 mpl-2.0-no-copyleft-exception this source code form is incompatible with @secondary licenses
62 mpl-1.1 the contents of this file are subject to the @mozilla public license version 1 1
62 mpl-1.0 the contents of this file are subject to the @mozilla public license version 1 0
60 npl-1.1 the contents of this file are subject to the @netscape public license version 1 1
60 epl-2.0 this program and the accompanying materials are made available under the terms of the @eclipse public license 2 0
62 epl-2.0 this program and the accompanying materials are made available under the terms of the @eclipse public license v 2 0
62 epl-1.0 this program and the accompanying materials are made available under the terms of the @eclipse public license v1 0
60 cddl-1.0 the contents of this file are subject to the terms of the common @development and distribution license
60 cpl-1.0 this program and the accompanying materials are made available under the terms of the @common public license v1 0
60 ipl-1.0 the accompanying program is provided under the terms of this @ibm public license
60 artistic-2.0 this license establishes the terms under which a given free software @package
60 artistic the intent of this document is to state the conditions under which a package may be @copied such that the copyright holder maintains some semblance of artistic control
58 perl you can redistribute it and or modify it under the same terms as @perl itself
60 zlib this software is provided as is without any express or implied @warranty in no event will the authors be held liable for any damages arising
60 zlib the origin of this software must not be @misrepresented
60 zlib altered source versions must be plainly @marked as such
60 libpng this software is based in part on the @libpng
60 ijg this software is based in part on the work of the independent @jpeg group
60 boost-1.0 distributed under the @boost software license version 1 0
60 boost-1.0 obtaining a copy of the software and accompanying documentation covered by this license the @software to use reproduce display distribute execute and transmit
60 unlicense this is free and @unencumbered software released into the public domain
60 unlicense anyone is free to copy modify publish use @compile sell or distribute this software
60 wtfpl do what the fuck you @want to
60 cc0-1.0 to the extent possible under law (?:the )?(?:author|authors|person|[^ ]+) (?:[^ ]+ ){0,6}waived all @copyright and related or neighboring rights
60 cc0-1.0 the person who associated a work with this deed has @dedicated the work to the public domain
62 cc-by-4.0 this work is licensed under a creative @commons attribution 4 0 international license
62 cc-by-sa-4.0 this work is licensed under a creative @commons attribution sharealike 4 0 international license
62 cc-by-nc-4.0 this work is licensed under a creative @commons attribution noncommercial 4 0 international license
62 cc-by-nc-sa-4.0 this work is licensed under a creative @commons attribution noncommercial sharealike 4 0 international license
62 cc-by-nc-nd-4.0 this work is licensed under a creative @commons attribution noncommercial noderivatives 4 0 international license
62 cc-by-nd-4.0 this work is licensed under a creative @commons attribution noderivatives 4 0 international license
62 cc-by-3.0 this work is licensed under a creative @commons attribution 3 0 unported license
62 cc-by-sa-3.0 this work is licensed under a creative @commons attribution share ?alike 3 0 unported license
60 cc-by (?:http|https) @creativecommons org licenses by [1-4] [05]
60 cc-by-sa (?:http|https) @creativecommons org licenses by sa [1-4] [05]
60 cc-by-nc (?:http|https) @creativecommons org licenses by nc [1-4] [05]
60 cc-by-nd (?:http|https) @creativecommons org licenses by nd [1-4] [05]
60 cc-by-nc-sa (?:http|https) @creativecommons org licenses by nc sa [1-4] [05]
60 cc-by-nc-nd (?:http|https) @creativecommons org licenses by nc nd [1-4] [05]
60 cc0-1.0 (?:http|https) @creativecommons org publicdomain zero 1 0
60 public-domain-mark (?:http|https) @creativecommons org publicdomain mark 1 0
60 apache-2.0 (?:http|https) (?:www )?@apache org licenses license 2 0
60 gpl (?:http|https) (?:www )?@gnu org (?:licenses|copyleft) gpl
60 lgpl (?:http|https) (?:www )?@gnu org (?:licenses|copyleft) (?:lgpl|lesser)
60 agpl (?:http|https) (?:www )?@gnu org licenses agpl
60 gfdl (?:http|https) (?:www )?@gnu org licenses fdl
60 mit (?:http|https) (?:www )?@opensource org licenses mit(?: license php)?
60 bsd (?:http|https) (?:www )?@opensource org licenses bsd(?: license php)?
60 isc (?:http|https) (?:www )?@opensource org licenses isc
60 mpl-2.0 (?:http|https) (?:www )?@mozilla org (?:en us )?mpl 2 0
60 epl (?:http|https) (?:www )?@eclipse org legal epl
60 boost-1.0 (?:http|https) (?:www )?@boost org license 1 0 txt
60 ofl-1.1 (?:http|https) (?:scripts )?@sil org ofl
60 unlicense (?:http|https) @unlicense org
60 wtfpl (?:http|https) (?:www )?@wtfpl net
60 ofl-1.1 this font software is licensed under the @sil open font license version 1 1
60 ofl the fonts and @derivatives however cannot be released under any other type of license
60 odbl-1.0 this database is made available under the open @database license
60 odc-by-1.0 this database is made available under the open data commons @attribution license
60 pddl-1.0 this database is made available under the public domain @dedication and license
60 psf-2.0 psf is making @python available to licensee on an as is basis
60 python this license agreement is between the python software foundation psf and the individual or @organization licensee accessing and otherwise using (?:this software )?python
60 php-3.01 this product includes @php software freely available from
60 ruby you may make your own copies of the software in any way provided that you do at least @one of the following
60 vim there are no restrictions on distributing unmodified copies of @vim
60 openssl this product includes software developed by the @openssl project
60 ssleay this product includes cryptographic software written by eric @young
60 curl copyright c 1996 (?:[0-9]+ )?daniel @stenberg
60 json the software shall be used for good not @evil
60 beerware if we meet some day and you think this stuff is worth it you can buy me a @beer
60 postgresql permission to use copy modify and distribute this software and its documentation for any purpose without @fee and without a written agreement is hereby granted
60 ncsa to deal with the software without @restriction
60 w3c this work is being provided by the copyright holders under the following license by obtaining @using and or copying this work
60 unicode unicode inc makes no @claims as to fitness
60 unicode permission is hereby granted free of charge to any person obtaining a copy of the @unicode data files
60 icu copyright c 1995 (?:[0-9]+ )?international business machines @corporation and others
60 ftl portions of this software are copyright (?:[^ ]+ ){0,4}the @freetype project
60 sleepycat redistributions in any form must be accompanied by information on how to obtain complete source code for the @db software
60 sspl-1.0 if you make the functionality of the program or a modified version available to third @parties as a service you must make the service source code available
60 busl-1.1 the licensor hereby grants you the right to copy modify create derivative works redistribute and make non @production use of the licensed work
60 elastic-2.0 you may not provide the software to third parties as a @hosted or managed service
60 commons-clause the license does not grant to you the right to @sell the software
60 polyform-noncommercial any @noncommercial purpose is a permitted purpose
60 polyform-shield any purpose is a permitted purpose except for providing any product that @competes with the software
60 hippocratic the software may not be used by individuals corporations governments or other groups for systems or @activities that actively and knowingly endanger harm
60 openrail use based @restrictions set forth as a minimum in paragraph 5
60 llama-community llama (?:2|3)(?: 1)? is licensed under the llama (?:2|3)(?: 1)? @community license
60 gemma gemma is provided under and subject to the @gemma terms of use
60 nasa-1.3 this software is provided under the nasa open source @agreement
60 ms-pl this license governs use of the accompanying software if you use the software you accept this license .{0,40}microsoft @public license
60 eupl-1.2 licensed under the @eupl version 1 2
60 eupl-1.1 licensed under the @eupl version 1 1
60 cecill-2.1 this software is governed by the @cecill license under french law
60 lppl-1.3c this work may be distributed and or modified under the conditions of the @latex project public license
60 osl-3.0 licensed under the open software license version @3 0
60 afl-3.0 licensed under the academic free license version @3 0
60 upl-1.0 licensed under the universal @permissive license v 1 0
60 mulanpsl-2.0 licensed under @mulan psl v2
60 public-domain this (?:file|code|software|work) is in the public @domain
60 public-domain has been placed in the public @domain
60 public-domain this is a work of the (?:u s|us|united states) @government
60 public-domain the author hereby @disclaims copyright to this source code
58 dual-mit-apache licensed under either of (?:the )?apache license version 2 0 .{0,60}or (?:the )?@mit license
58 dual-mit-apache licensed under the mit license or the @apache license
58 dual-gpl-bsd dual @bsd gpl
58 dual-mit-gpl dual licensed under the mit (?:and|or) @gpl
55 proprietary this software is @confidential and proprietary
55 proprietary this software contains confidential and @proprietary information
55 proprietary no part of this (?:publication|software|document|work) may be @reproduced
55 proprietary unauthorized (?:copying|use|reproduction) of this (?:file|software) (?:via any medium )?is strictly @prohibited
55 proprietary you may not reverse @engineer decompile or disassemble
55 proprietary by installing (?:copying )?or otherwise using (?:the|this) software you agree to be @bound
55 evaluation for @evaluation purposes only
55 non-commercial for non commercial @use only
55 non-commercial may not be used for @commercial purposes
55 academic for academic (?:and|or) @research use only
55 educational for @educational (?:use|purposes) only
55 shareware this is @shareware
55 freeware this (?:program|software) is @freeware
55 no-derivatives no @derivative works (?:are )?(?:allowed|permitted)
55 no-ai may not be used to @train (?:any )?(?:machine learning|artificial intelligence|ai|language) models?
55 all-rights-reserved copyright (?:c )?(?:[0-9]+ )?(?:[^ ]+ ){1,5}all rights @reserved
"""


def wording() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) of each line."""
    out = []
    for line in WORDING.strip().splitlines():
        priority, label, pattern = line.split(" ", 2)
        out.append((int(priority), label, re.search(r"@([a-z0-9]+)", pattern).group(1), pattern))
    return out
