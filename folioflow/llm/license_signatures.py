"""Hand-written signatures of licenses, as patterns over lower-case words joined by single spaces.

Each line is a label, the rarest word that every match holds, and the pattern. Tables are
in order of priority: a detection gives way to one of an earlier table around it.
"""

#: Sentences of the licenses' own texts. The licenses' wording.
TEXTS = (
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this (?:software|work)(?: and associated documentation files)?"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-advertising", "publicity", r"shall be included in all copies of the software its documentation and marketing and publicity materials"),
    ("boost", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("boost", "executable", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("ofl-1.1", "font", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl-1.1", "font", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl-1.1", "reserved", r"no modified version of the font software may use the reserved font name"),
    ("isc", "fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("hpnd", "documentation", r"permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose (?:and without fee )?is hereby granted(?: without fee)?"),
    ("postgresql", "written", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:\S+ ){1,14}may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-no-nuclear", "nuclear", r"(?:is|are) not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-patent", "perpetual", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("bsd-source-code", "permission", r"neither the name of the author nor the names of (?:its|any) contributors may be used without specific prior written permission"),
    ("apache-1.0", "apache", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-1.1", "apache", r"the names apache and apache software foundation must not be used to endorse or promote products"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-2", "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright license|except as stated in this section)"),
    ("apache-2", "definitions", r"terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-2", "submitted", r"any contribution intentionally submitted for inclusion in the work by you to the licensor shall be under the terms and conditions of this license"),
    ("zlib", "authors", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "png", r"the png reference library is supplied as is"),
    ("libpng", "42", r"the contributing authors and group 42 inc specifically permit without fee"),
    ("gpl-1", "mercy", r"the license agreements of most software companies try to keep users at the mercy of those companies"),
    ("gpl-2", "guarantee", r"the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("gpl-2", "verbatim", r"you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("gpl-3", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "convey", r"you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-3", "propagate", r"to propagate a work means to do anything with it that without permission would make you directly or secondarily liable"),
    ("agpl-3", "copyleft", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3", "interacting", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("lgpl-2", "library", r"this license the library general public license applies to some specially designated free software foundation software"),
    ("lgpl-2.1", "lesser", r"this license the lesser general public license applies to some specially designated software packages"),
    ("lgpl-2.1", "library", r"a work that uses the library in isolation is not a derivative work of the library"),
    ("lgpl-3", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl-3", "combined", r"you may convey a combined work under terms of your choice that taken together effectively do not restrict"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "manual", r"the purpose of this license is to make a manual textbook or other functional and useful document free"),
    ("mpl-1.1", "initial", r"the initial developer hereby grants you a world wide royalty free non exclusive license subject to third party intellectual property claims"),
    ("mpl-2", "incompatible", r"this source code form is incompatible with secondary licenses"),
    ("mpl-2", "larger", r"you may create and distribute a larger work under terms of your choice provided that you also comply with the requirements of this license for the covered software"),
    ("epl-1", "recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("epl-2", "secondary", r"may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public license"),
    ("cpl-1", "common", r"the accompanying program is provided under the terms of this common public license"),
    ("cddl-1.1", "originally", r"original software means the computer software and other technology originally released under this license"),
    ("eupl-1.2", "european", r"the european union public licence the eupl applies to the work"),
    ("artistic", "intent", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "establishes", r"this license establishes the terms under which a given free software package may be copied"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "successors", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("python-2", "psf", r"psf is making python available to licensee on an as is basis"),
    ("python-2", "psf", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("openssl", "toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("cc0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("cc-by", "adapt", r"you are free to share copy and redistribute the material in any medium or format and adapt remix transform and build upon the material"),
    ("cc-by", "credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "material", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "transform", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "transform", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("ms-pl", "software", r"if you use the software you accept this license if you do not accept the license do not use the software"),
    ("ms-rl", "recipients", r"for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file along with a copy of this license"),
    ("afl-3", "sublicensable", r"licensor hereby grants you a worldwide royalty free non exclusive sublicensable license for the duration of the copyright"),
    ("osl-3", "deployment", r"the term external deployment means the use distribution or communication of the original work"),
    ("ncsa", "endorse", r"neither the names of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission the software is provided"),
    ("x11", "x", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("curl", "holder", r"except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale"),
    ("unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"portions of this software are copyright (?:\S+ ){1,4}the freetype project"),
    ("ruby", "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("php-3", "php", r"this product includes php software freely available from"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("sleepycat", "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("blessing", "forgiveness", r"may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("sspl-1", "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("openrail", "restrictions", r"use based restrictions(?: as)? referenced in paragraph 5 must be included"),
    ("llama-2", "llama", r"llama 2 is licensed under the llama 2 community license"),
)
#: Exceptions to licenses, and identifiers that files state of themselves.
IDENTIFIERS = (
    ("classpath-exception-2.0", "classpath", r"(?:with )?classpath exception(?: 2 0)?"),
    ("classpath-exception-2.0", "linking", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception-3.1", "gcc", r"(?:with )?gcc (?:runtime library )?exception(?: (?:version )?3 1)?"),
    ("llvm-exception", "llvm", r"(?:with )?llvm exceptions?"),
    ("linux-syscall-note", "syscall", r"(?:with )?linux syscall note"),
    ("autoconf-exception", "autoconf", r"(?:with )?autoconf exception(?: [23] 0)?"),
    ("bison-exception-2.2", "bison", r"(?:with )?bison exception(?: 2 2)?"),
    ("font-exception-2.0", "font", r"(?:with )?font exception(?: 2 0)?"),
    ("openssl-exception", "openssl", r"(?:permission to link|special exception to link) (?:\S+ ){0,8}with the openssl (?:project s )?(?:openssl )?library"),
    ("universal-foss-exception", "foss", r"universal foss exception(?: (?:version )?1 0)?"),
    ("mit", "spdx", r"spdx license identifier mit(?! (?:0|advertising|cmu|modern)(?!\S))"),
    ("mit-0", "spdx", r"spdx license identifier mit 0"),
    ("mit-cmu", "spdx", r"spdx license identifier mit cmu"),
    ("apache-1.1", "spdx", r"spdx license identifier apache 1 1"),
    ("apache-2", "spdx", r"spdx license identifier apache 2 0"),
    ("0bsd", "spdx", r"spdx license identifier 0bsd"),
    ("bsd-1-clause", "spdx", r"spdx license identifier bsd 1 clause"),
    ("bsd-2-clause", "spdx", r"spdx license identifier bsd 2 clause(?! patent)"),
    ("bsd-2-clause-patent", "spdx", r"spdx license identifier bsd 2 clause patent"),
    ("bsd-3-clause", "spdx", r"spdx license identifier bsd 3 clause(?! clear)"),
    ("bsd-3-clause-clear", "spdx", r"spdx license identifier bsd 3 clause clear"),
    ("bsd-4-clause", "spdx", r"spdx license identifier bsd 4 clause"),
    ("isc", "spdx", r"spdx license identifier isc"),
    ("zlib", "spdx", r"spdx license identifier zlib"),
    ("libpng", "spdx", r"spdx license identifier libpng(?: 2 0)?"),
    ("gpl-1", "spdx", r"spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2", "spdx", r"spdx license identifier gpl 2 0(?: only| or later)?"),
    ("gpl-3", "spdx", r"spdx license identifier gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "spdx", r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "spdx", r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "spdx", r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "spdx", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("gfdl", "spdx", r"spdx license identifier gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "spdx", r"spdx license identifier mpl 1 1"),
    ("mpl-2", "spdx", r"spdx license identifier mpl 2 0"),
    ("epl-1", "spdx", r"spdx license identifier epl 1 0"),
    ("epl-2", "spdx", r"spdx license identifier epl 2 0"),
    ("cddl", "spdx", r"spdx license identifier cddl 1 [01]"),
    ("eupl", "spdx", r"spdx license identifier eupl 1 [012]"),
    ("artistic", "spdx", r"spdx license identifier artistic 1 0"),
    ("artistic-2", "spdx", r"spdx license identifier artistic 2 0"),
    ("boost", "spdx", r"spdx license identifier bsl 1 0"),
    ("busl-1.1", "spdx", r"spdx license identifier busl 1 1"),
    ("unlicense", "spdx", r"spdx license identifier unlicense"),
    ("wtfpl", "spdx", r"spdx license identifier wtfpl"),
    ("python-2", "spdx", r"spdx license identifier (?:python|psf) 2 0"),
    ("postgresql", "spdx", r"spdx license identifier postgresql"),
    ("openssl", "spdx", r"spdx license identifier openssl"),
    ("ofl-1.1", "spdx", r"spdx license identifier ofl 1 1"),
    ("ms-pl", "spdx", r"spdx license identifier ms pl"),
    ("ms-rl", "spdx", r"spdx license identifier ms rl"),
    ("upl-1", "spdx", r"spdx license identifier upl 1 0"),
    ("ncsa", "spdx", r"spdx license identifier ncsa"),
    ("cc0", "spdx", r"spdx license identifier cc0 1 0"),
    ("cc-by", "spdx", r"spdx license identifier cc by [1-4] 0"),
    ("cc-by-sa", "spdx", r"spdx license identifier cc by sa [1-4] 0"),
    ("cc-by-nd", "spdx", r"spdx license identifier cc by nd [1-4] 0"),
    ("cc-by-nc", "spdx", r"spdx license identifier cc by nc [1-4] 0"),
    ("cc-by-nc-sa", "spdx", r"spdx license identifier cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", "spdx", r"spdx license identifier cc by nc nd [1-4] 0"),
    ("sspl-1", "spdx", r"spdx license identifier sspl 1 0"),
    ("elastic-2", "spdx", r"spdx license identifier elastic 2 0"),
)
#: Headers that put a file under a license.
HEADERS = (
    ("apache-2", "compliance", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "contributor", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "obtain", r"you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-1", "foundation", r"(?:it under the terms of the )?gnu general public license as published by the free software foundation either version 1"),
    ("gpl-2", "foundation", r"(?:it under the terms of the )?gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?"),
    ("gpl-2", "foundation", r"gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3", "foundation", r"(?:it under the terms of the )?gnu general public license (?:version 3 )?as published by the free software foundation (?:either )?version 3(?: of the license)?"),
    ("lgpl-2", "library", r"(?:it under the terms of the )?gnu library general public license as published by the free software foundation (?:either )?version 2"),
    ("lgpl-2.1", "lesser", r"(?:it under the terms of the )?gnu lesser general public license as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3", "lesser", r"(?:it under the terms of the )?gnu lesser general public license as published by the free software foundation (?:either )?version 3"),
    ("agpl-3", "affero", r"(?:it under the terms of the )?gnu affero general public license as published by the free software foundation (?:either )?version 3"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v ?2 0"),
    ("epl-1", "eclipse", r"(?:made available )?under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2", "eclipse", r"(?:made available )?under the terms of the eclipse public license v(?:ersion)? ?2 0"),
    ("cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "development", r"subject to the terms of the common development and distribution license"),
    ("eupl-1.2", "eupl", r"licensed under the eupl version 1 2 or as soon they will be approved by the european commission"),
    ("ofl-1.1", "sil", r"this font software is licensed under the sil open font license version 1 1"),
    ("boost", "boost", r"distributed under the boost software license version 1 0"),
    ("artistic-2", "artistic", r"under the terms of the artistic license(?: version)? 2 0"),
    ("perl", "perl", r"under the same terms as (?:the )?perl(?: 5)?(?: programming language system)?(?: itself)?"),
    ("bsd", "bsd", r"use of this source code is governed by a bsd style license that can be found in the license file"),
    ("mit", "mit", r"use of this source code is governed by an mit style license that can be found in the license file"),
    ("php-3", "php", r"this source file is subject to version 3(?: 01?)? of the php license"),
    ("qpl-1", "q", r"this file may be distributed under the terms of the q public license"),
    ("afl-3", "academic", r"licensed under the academic free license version 3 0"),
    ("osl-3", "open", r"licensed under the open software license version 3 0"),
    ("cc-by", "creative", r"this work is licensed under a creative commons attribution(?: [1-4] 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-sa", "creative", r"this work is licensed under (?:a|the) creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-nd", "creative", r"this work is licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-nc", "creative", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-nc-sa", "creative", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-nc-nd", "creative", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] 0)?(?: international| unported)? licen[sc]e"),
    ("cc0", "waived", r"to the extent possible under law (?:\S+ ){1,8}waived all copyright and related or neighboring rights"),
    ("public-domain", "domain", r"(?:this (?:file|work|software|program|code) (?:is|has been) )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", r"(?:this (?:file|work|software|program|code) )?is in the public domain"),
    ("proprietary", "proprietary", r"(?:this (?:file|software|document) )?(?:is|contains) (?:the )?(?:confidential and )?proprietary (?:and confidential )?(?:information|property|software) of"),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited"),
)
#: Addresses of license texts.
URLS = (
    ("mit", "opensource", r"opensource org licenses? mit(?: license)?(?: php| html)?"),
    ("apache-2", "apache", r"(?:www )?apache org licenses license 2 0(?: html| txt)?"),
    ("apache-2", "opensource", r"opensource org licenses? apache 2 0"),
    ("apache-1.1", "apache", r"(?:www )?apache org licenses license 1 1"),
    ("bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause"),
    ("bsd", "opensource", r"opensource org licenses? bsd license(?: php)?"),
    ("isc", "opensource", r"opensource org licenses? isc"),
    ("zlib", "opensource", r"opensource org licenses? zlib"),
    ("mpl-2", "opensource", r"opensource org licenses? mpl 2 0"),
    ("artistic-2", "opensource", r"opensource org licenses? artistic 2 0"),
    ("eupl", "opensource", r"opensource org licenses? eupl 1 [12]"),
    ("ms-pl", "opensource", r"opensource org licenses? ms pl"),
    ("gpl-2", "opensource", r"opensource org licenses? gpl 2 0"),
    ("gpl-3", "opensource", r"opensource org licenses? gpl 3 0"),
    ("lgpl-3", "opensource", r"opensource org licenses? lgpl 3 0"),
    ("agpl-3", "opensource", r"opensource org licenses? agpl 3 0"),
    ("gpl", "gnu", r"(?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt)?(?! [123] 0)"),
    ("gpl-2", "gnu", r"(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"),
    ("gpl-3", "gnu", r"(?:www )?gnu org licenses gpl 3 0(?: html| txt)?"),
    ("lgpl", "gnu", r"(?:www )?gnu org (?:licenses|copyleft) lgpl(?: html| txt)?(?! [23] [01])"),
    ("lgpl-2.1", "gnu", r"(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?"),
    ("lgpl-3", "gnu", r"(?:www )?gnu org licenses lgpl 3 0(?: html| txt)?"),
    ("agpl-3", "gnu", r"(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gfdl", "gnu", r"(?:www )?gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: html| txt)?"),
    ("mpl-1.1", "mozilla", r"(?:www )?mozilla org mpl mpl 1 1(?: html| txt)?"),
    ("mpl-2", "mozilla", r"(?:www )?mozilla org (?:en us )?mpl 2 0"),
    ("mpl", "mozilla", r"(?:www )?mozilla org mpl(?! (?:mpl|2)(?!\S))"),
    ("epl-1", "eclipse", r"(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-2", "eclipse", r"(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?"),
    ("boost", "boost", r"(?:www )?boost org license 1 0(?: txt)?"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"(?:www )?wtfpl net"),
    ("ofl-1.1", "sil", r"scripts sil org ofl"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0(?: legalcode| deed \S+)?"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05](?: legalcode| deed \S+)?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05](?: legalcode| deed \S+)?"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] [05](?: legalcode| deed \S+)?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] [05](?: legalcode| deed \S+)?"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05](?: legalcode| deed \S+)?"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05](?: legalcode| deed \S+)?"),
    ("odbl-1", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1", "opendatacommons", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("ogl-uk", "nationalarchives", r"(?:www )?nationalarchives gov uk doc open government licence(?: version [123])?"),
    ("polyform", "polyformproject", r"polyformproject org licenses (?:noncommercial|small business|shield|strict|perimeter)(?: 1 0 0)?"),
    ("busl-1.1", "mariadb", r"mariadb com bsl11"),
    ("elastic-2", "elastic", r"(?:www )?elastic co licensing elastic license"),
)
#: Full names.
NAMES = (
    ("mit", "mit", r"(?:under (?:the )?)?(?:terms of (?:the )?)?mit licen[sc]e(?! (?:no attribution|0)(?!\S))"),
    ("mit", "mit", r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?mit(?! (?:no attribution|0)(?!\S))"),
    ("mit", "lizenz", r"mit lizenz"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:v ?|version )?1 1"),
    ("apache-2", "apache", r"apache (?:software )?licen[sc]e (?:v ?|version )?2(?: 0)?"),
    ("apache-2", "apache", r"apache(?: software)? 2(?: 0)? licen[sc]e"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e(?! (?:v |version )?[12](?!\S))"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause|0 clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd style bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "freebsd", r"freebsd licen[sc]e"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?"),
    ("bsd", "bsd", r"(?:licen[sc]ed under (?:the )?)?bsd(?: style)? licen[sc]es?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("gpl-1", "gnu", r"gnu general public licen[sc]e(?: gpl)? (?:v ?|version )1(?: 0)?"),
    ("gpl-2", "gnu", r"gnu general public licen[sc]e(?: gpl)? (?:v ?|version )2(?: 0)?(?: or (?:any )?later(?: version)?)?"),
    ("gpl-3", "gnu", r"gnu general public licen[sc]e(?: gpl)? (?:v ?|version )3(?: 0)?(?: or (?:any )?later(?: version)?)?"),
    ("gpl", "gnu", r"gnu general public licen[sc]e(?!(?: gpl)? (?:v ?|version )[123](?!\S))"),
    ("gpl", "gnu", r"gnu public licen[sc]e"),
    ("gpl-2", "gpl", r"gnu gpl (?:v ?|version )2(?: 0)?"),
    ("gpl-3", "gpl", r"gnu gpl (?:v ?|version )3(?: 0)?"),
    ("lgpl-2", "gnu", r"gnu library general public licen[sc]e(?: (?:v ?|version )2(?: 0)?)?"),
    ("lgpl-2.1", "gnu", r"gnu (?:lesser|library) general public licen[sc]e(?: lgpl)? (?:v ?|version )2 1(?: or (?:any )?later(?: version)?)?"),
    ("lgpl-3", "gnu", r"gnu lesser general public licen[sc]e(?: lgpl)? (?:v ?|version )3(?: 0)?(?: or (?:any )?later(?: version)?)?"),
    ("lgpl", "gnu", r"gnu lesser general public licen[sc]e(?!(?: lgpl)? (?:v ?|version )[23](?!\S))"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[sc]e(?: (?:v ?|version )3(?: 0)?)?"),
    ("gfdl", "documentation", r"gnu free documentation licen[sc]e(?: (?:v ?|version )1 [123])?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: mpl)? (?:v ?|version )?1 [01]"),
    ("mpl-2", "mozilla", r"mozilla public licen[sc]e(?: mpl)? (?:v ?|version )?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e(?!(?: mpl)? (?:v |version )?[12](?!\S))"),
    ("epl-1", "eclipse", r"eclipse public licen[sc]e (?:v ?|version )?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public licen[sc]e (?:v ?|version )?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e(?! (?:v |version )?[12](?!\S))"),
    ("edl-1", "eclipse", r"eclipse distribution licen[sc]e(?: (?:v ?|version )?1 0)?"),
    ("cpl-1", "common", r"common public licen[sc]e(?: (?:v ?|version )?1 0)?"),
    ("ipl-1", "ibm", r"ibm public licen[sc]e(?: (?:v ?|version )?1 0)?"),
    ("cddl", "common", r"common development and distribution licen[sc]e(?: cddl)?(?: (?:v ?|version )?1 [01])?"),
    ("eupl", "european", r"european union public licen[sc]e(?: eupl)?(?: (?:v ?|version )?1 [012])?"),
    ("artistic-2", "artistic", r"artistic licen[sc]e (?:v ?|version )?2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[sc]e(?! (?:v |version )?2(?!\S))"),
    ("boost", "boost", r"boost (?:software )?licen[sc]e(?: (?:v ?|version )?1(?: 0)?)?"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e"),
    ("python-2", "python", r"python (?:software foundation )?licen[sc]e(?: agreement)?(?: (?:v ?|version )?2(?: 0)?)?"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("ofl-1.1", "sil", r"sil open font licen[sc]e(?: (?:v ?|version )?1 1)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("upl-1", "universal", r"universal permissive licen[sc]e(?: (?:v ?|version )?1 0)?"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source licen[sc]e"),
    ("ecl-2", "educational", r"educational community licen[sc]e(?: (?:v ?|version )?2 0)?"),
    ("afl-3", "academic", r"academic free licen[sc]e(?: (?:v ?|version )?[23] [01])?"),
    ("osl-3", "software", r"open software licen[sc]e (?:v ?|version )?3 0"),
    ("qpl-1", "q", r"q public licen[sc]e"),
    ("ruby", "ruby", r"ruby(?: s)? licen[sc]e"),
    ("php-3", "php", r"php licen[sc]e(?: (?:v ?|version )?3 0?1?)?"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("curl", "curl", r"curl licen[sc]e"),
    ("ijg", "jpeg", r"independent jpeg group licen[sc]e"),
    ("freetype", "freetype", r"freetype (?:project )?licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("beerware", "beerware", r"beerware licen[sc]e"),
    ("beerware", "beer", r"beer ware licen[sc]e"),
    ("sspl-1", "side", r"server side public licen[sc]e(?: (?:v ?|version )?1)?"),
    ("busl-1.1", "business", r"business source licen[sc]e(?: 1 1)?"),
    ("elastic-2", "elastic", r"elastic licen[sc]e(?: (?:v ?|version )?2(?: 0)?)?"),
    ("commons-clause", "clause", r"commons clause(?: licen[sc]e condition)?(?: v1 0)?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[sc]e)?"),
    ("openrail", "rail", r"(?:creativeml |bigscience |bigcode )?open rail(?: m)?(?: licen[sc]e)?"),
    ("openrail", "responsible", r"responsible ai licen[sc]e"),
    ("llama-2", "llama", r"llama 2 community licen[sc]e(?: agreement)?"),
    ("llama-3", "llama", r"llama 3(?: [1-3])? community licen[sc]e(?: agreement)?"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("odbl-1", "database", r"open (?:data commons open )?database licen[sc]e(?: (?:v ?|version )?1 0)?"),
    ("odc-by", "commons", r"open data commons attribution licen[sc]e"),
    ("ogl-uk", "government", r"open government licen[sc]e(?: (?:v ?|version )?[123](?: 0)?)?"),
    ("cc0", "zero", r"creative commons (?:zero|cc0)(?: (?:v ?)?1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?! (?:no ?deriv|share ?alike))(?: [1-4] 0)?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] 0)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] 0)?"),
    ("cc-by", "creative", r"creative commons attribution(?! (?:non ?commercial|no ?deriv|share ?alike))(?: [1-4] 0)?"),
    ("creative-commons", "creative", r"creative commons licen[sc]e"),
)
#: Short names and notices.
SHORT = (
    ("gpl-1", "gpl", r"gpl (?:v ?|version )?1(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gpl", r"gpl (?:v ?|version )?2(?: 0)?(?: only| or (?:any )?later)?"),
    ("gpl-3", "gpl", r"gpl (?:v ?|version )?3(?: 0)?(?: only| or (?:any )?later)?"),
    ("gpl", "gpl", r"gpl(?! (?:v ?|version )?[123](?!\S))"),
    ("gpl-2", "gplv2", r"gplv2(?: 0)?(?: only| or (?:any )?later)?"),
    ("gpl-2", "gpl2", r"gpl2(?: 0)?(?: only| or (?:any )?later)?"),
    ("gpl-3", "gplv3", r"gplv3(?: 0)?(?: only| or (?:any )?later)?"),
    ("gpl-3", "gpl3", r"gpl3(?: 0)?(?: only| or (?:any )?later)?"),
    ("lgpl-2.1", "lgpl", r"lgpl (?:v ?|version )?2 1(?: only| or (?:any )?later)?"),
    ("lgpl-2", "lgpl", r"lgpl (?:v ?|version )?2(?: 0)?(?! 1(?!\S))(?: only| or (?:any )?later)?"),
    ("lgpl-3", "lgpl", r"lgpl (?:v ?|version )?3(?: 0)?(?: only| or (?:any )?later)?"),
    ("lgpl", "lgpl", r"lgpl(?! (?:v ?|version )?[23](?!\S))"),
    ("lgpl-2.1", "lgplv2", r"lgplv2 1(?: only| or (?:any )?later)?"),
    ("lgpl-2", "lgplv2", r"lgplv2(?: 0)?(?! 1(?!\S))(?: only| or (?:any )?later)?"),
    ("lgpl-2.1", "lgpl2", r"lgpl2 1(?: only| or (?:any )?later)?"),
    ("lgpl-3", "lgplv3", r"lgplv3(?: 0)?(?: only| or (?:any )?later)?"),
    ("lgpl-3", "lgpl3", r"lgpl3(?: 0)?(?: only| or (?:any )?later)?"),
    ("agpl-3", "agpl", r"agpl(?: (?:v ?|version )?3)?(?: 0)?(?: only| or (?:any )?later)?"),
    ("agpl-3", "agplv3", r"agplv3(?: 0)?(?: only| or (?:any )?later)?"),
    ("agpl-3", "agpl3", r"agpl3(?: 0)?(?: only| or (?:any )?later)?"),
    ("mpl-1.1", "mpl", r"mpl (?:v ?|version )?1 1"),
    ("mpl-2", "mpl", r"mpl (?:v ?|version )?2(?: 0)?"),
    ("mpl-1.1", "mplv1", r"mplv1 1"),
    ("mpl-2", "mplv2", r"mplv2(?: 0)?"),
    ("mpl-2", "mpl2", r"mpl2(?: 0)?"),
    ("apache-2", "apachev2", r"apachev2(?: 0)?"),
    ("apache-2", "apache2", r"apache2(?: 0)?"),
    ("apache-2", "apache", r"apache 2 0"),
    ("apache-2", "asl", r"asl (?:v ?|version )?2(?: 0)?"),
    ("epl-1", "eplv1", r"eplv1(?: 0)?"),
    ("epl-2", "eplv2", r"eplv2(?: 0)?"),
    ("epl-1", "epl", r"epl (?:v ?|version )?1 0"),
    ("epl-2", "epl", r"epl (?:v ?|version )?2 0"),
    ("eupl", "eupl", r"eupl(?: (?:v ?|version )?1 [012])?"),
    ("eupl", "euplv1", r"euplv1(?: [012])?"),
    ("cddl", "cddl", r"cddl(?: (?:v ?|version )?1 [01])?"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("sspl-1", "sspl", r"sspl(?: (?:v ?|version )?1)?"),
    ("ofl-1.1", "ofl", r"ofl(?: (?:v ?|version )?1 1)?"),
    ("odbl-1", "odbl", r"odbl(?: (?:v ?|version )?1 0)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", r"cc by nc(?! (?:nd|sa)(?!\S))(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by", "cc", r"cc by(?! (?:nc|nd|sa)(?!\S))(?: [1-4] 0)?"),
    ("copyright", "copyright", r"copyright (?:(?:c|©) )?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", "©", r"© (?:copyright )?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", "reserved", r"all rights reserved"),
)
#: The tables in order of priority, and how sure a detection of each is.
TABLES = ((TEXTS, 1.0), (IDENTIFIERS, 1.0), (HEADERS, 0.95), (URLS, 0.9), (NAMES, 0.85), (SHORT, 0.7))
