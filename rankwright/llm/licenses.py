"""License scans by ordered signature rules, DataFrame operations only.

Texts are reduced to lower-case words. Their words are intersected with the
keywords of all rules, which sends most documents past the scanner and tells
for the rest which rules to match: those of the keywords found. Each rule of
which a keyword occurs is matched and gives intervals. Detections are passed in the order of start, longer ones
first: one whose interval lies inside that of the one that stands is
suppressed, and of two that overlap in part the one of better priority stands.
Everything happens in the document's own row: no shuffle.

Rules: four kinds (SPDX tag, address, grant sentence, bare name) for each
license of LICENSES, and hand-written sentences of license texts.

Cases: a null text is empty; documents without any keyword have no label
and score 0; a document's repeated mentions all count in ``n_base`` and give
one label; rows stand for themselves, so repeated rows repeat; an empty table
gives an empty result; more columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import fold_ascii, matches, spread, table, whole_text

#: label, keywords (one of them begins a word of every match), name (a regex over words), SPDX id as words, address as words
LICENSES = [
    ("mit", "mit", "mit", "mit", "opensource org licenses mit"),
    ("apache-2.0", "apache|apache2", "apache( software)?( license)?( version)?( v)? ?2( 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", "apache", "apache( software)?( license)?( version)? 1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("gpl-2.0", "gnu", "gnu( general public license| gpl)( version| v)? ?2( 0)?", "gpl 2 0", "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", "gnu", "gnu( general public license| gpl)( version| v)? ?3( 0)?", "gpl 3 0", "gnu org licenses gpl 3 0"),
    ("lgpl-2.1", "gnu", "gnu( lesser general public license| lgpl)( version| v)? ?2 1", "lgpl 2 1", "gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3.0", "gnu", "gnu( lesser general public license| lgpl)( version| v)? ?3( 0)?", "lgpl 3 0", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "affero", "(gnu )?affero general public license( version| v)? ?3?( 0)?", "agpl 3 0", "gnu org licenses agpl 3 0"),
    ("gfdl", "documentation", "gnu free documentation license", "gfdl 1 3", "gnu org licenses fdl"),
    ("bsd-2-clause", "bsd", "(simplified bsd|bsd 2 clause|2 clause bsd)", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(new bsd|modified bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", "bsd|0bsd", "(zero clause bsd|bsd zero clause|0bsd)", "0bsd", "opensource org licenses 0bsd"),
    ("isc", "isc", "isc", "isc", "opensource org licenses isc"),
    ("mpl-1.1", "mozilla|mpl|mpl1", "(mozilla public license|mpl)( version| v)? ?1 1", "mpl 1 1", "mozilla org mpl mpl 1 1"),
    ("mpl-2.0", "mozilla|mpl|mpl2", "(mozilla public license|mpl)( version| v)? ?2( 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license( version| v)? ?1( 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", "eclipse public license( version| v)? ?2( 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1.0", "cddl|common|cddl1", "(common development and distribution license|cddl)( version| v)? ?1?( 0)?", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cpl-1.0", "common", "common public license( version)?( 1 0)?", "cpl 1 0", "ibm com developerworks library os cpl"),
    ("ipl-1.0", "ibm", "ibm public license( version)?( 1 0)?", "ipl 1 0", "opensource org licenses ipl 1 0"),
    ("artistic-1.0", "artistic", "artistic license( version)? 1( 0)?", "artistic 1 0", "opensource org licenses artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic license( version)? 2( 0)?", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("zlib", "zlib", "zlib( libpng)?", "zlib", "opensource org licenses zlib"),
    ("libpng", "libpng", "libpng", "libpng", "libpng org pub png src libpng license"),
    ("bsl-1.0", "boost", "boost software license( version)?( 1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl|fuck", "(wtfpl|do what the fuck you want to public license)", "wtfpl", "wtfpl net"),
    ("cc0-1.0", "cc0|creative", "(cc0|creative commons zero)( v| version)?( 1 0)?( universal)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-3.0", "creative", "creative commons attribution( v| version)? 3 0", "cc by 3 0", "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "creative", "creative commons attribution( v| version)? 4 0", "cc by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", "creative", "creative commons attribution share ?alike( v| version)? 3 0", "cc by sa 3 0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "creative", "creative commons attribution share ?alike( v| version)? 4 0", "cc by sa 4 0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "creative", "creative commons attribution non ?commercial( v| version)? 4 0", "cc by nc 4 0", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creative", "creative commons attribution no ?deriv(ative)?s( v| version)? 4 0", "cc by nd 4 0", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creative", "creative commons attribution non ?commercial share ?alike( v| version)? 4 0", "cc by nc sa 4 0", "creativecommons org licenses by nc sa 4 0"),
    ("ofl-1.1", "sil", "sil open font license( version)?( 1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl", "opensource org licenses ms rl"),
    ("python-2.0", "python", "python( software foundation)? license( version)?( 2)?", "python 2 0", "docs python org 3 license"),
    ("php-3.01", "php", "php license( version)?( 3( 01)?)?", "php 3 01", "php net license 3 01"),
    ("ruby", "ruby", "ruby license", "ruby", "ruby lang org en license"),
    ("vim", "vim", "vim license", "vim", "vimdoc sourceforge net htmldoc uganda"),
    ("postgresql", "postgresql", "postgresql license", "postgresql", "postgresql org about licence"),
    ("openssl", "openssl", "openssl license", "openssl", "openssl org source license"),
    ("x11", "x11", "x11", "x11", "xfree86 org 3 3 6 copyright2"),
    ("ncsa", "ncsa", "(university of illinois )?ncsa( open source license)?", "ncsa", "opensource org licenses ncsa"),
    ("eupl-1.2", "european", "european union public licen[cs]e( version| v)?( 1 2)?", "eupl 1 2", "joinup ec europa eu software page eupl"),
    ("eupl-1.1", "european", "european union public licen[cs]e( version| v)? 1 1", "eupl 1 1", "ec europa eu idabc eupl"),
    ("cecill-2.1", "cecill", "cecill( free software license agreement)?( version| v)?( 2 1)?", "cecill 2 1", "cecill info licences licence cecill v2 1"),
    ("osl-3.0", "open", "open software license( version| v)?( 3 0)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("afl-3.0", "academic", "academic free license( version| v)?( 3 0)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("sspl-1.0", "server", "server side public license( version| v)?( 1)?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("busl-1.1", "business", "business source license( version| v)?( 1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("elastic-2.0", "elastic", "elastic license( version| v)?( 2 0)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("odbl-1.0", "database", "open database license( version| v)?( 1 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("pddl-1.0", "pddl|dedication", "(public domain dedication and license|pddl)( version| v)?( 1 0)?", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("upl-1.0", "universal", "universal permissive license( version| v)?( 1 0)?", "upl 1 0", "opensource org licenses upl"),
    ("json", "json", "json license", "json", "json org license"),
    ("qpl-1.0", "qpl|q", "(q public license|qpl)( version| v)?( 1 0)?", "qpl 1 0", "opensource org licenses qpl 1 0"),
]

#: label, keywords, sentence (a regex over words)
SENTENCES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("gpl", "redistribute", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "gnu", "gnu general public license as published by the free software foundation (either )?version 2"),
    ("gpl-3.0", "gnu", "gnu general public license as published by the free software foundation (either )?version 3"),
    ("lgpl", "lesser", "terms of the gnu lesser general public license"),
    ("lgpl", "library", "terms of the gnu library general public license"),
    ("agpl", "affero", "terms of the gnu affero general public license"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("bsl-1.0", "boost", "distributed under the boost software license"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("public-domain", "domain", "(released|placed|dedicated) (in|into|to) the public domain"),
    ("proprietary", "rights", "all rights reserved"),
    ("proprietary", "confidential", "confidential and proprietary"),
    ("proprietary", "unauthorised|unauthorized", "unauthori[sz]ed (copying|reproduction|use) .{0,60}?(is )?(strictly )?prohibited"),
    ("cc", "creative", "licensed under (a |the )?creative commons"),
    ("other-permissive", "warranty|warranties", "provided as is without (any )?(express or implied )?warrant(y|ies)"),
    # MIT and its kin
    ("mit", "furnished", "to permit persons to whom the software is furnished to do so"),
    ("mit", "substantial", "this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "mit", "(this (project|software|library|package|module|code|file|work) is )?(licensed|released|distributed) under (the )?mit"),
    ("mit", "mit", "mit license see (the )?license( md| txt)?( file)?( for details)?"),
    ("mit-0", "attribution", "mit no attribution"),
    ("mit-advertising", "dealings", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used"),
    ("mit-feh", "acknowledgment|acknowledgement", "acknowledge?ment shall be given in the documentation and software packages that this software was used"),
    ("hpnd", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose (and without fee )?is hereby granted"),
    ("hpnd", "representations", "makes no representations about the suitability of this software for any purpose"),
    ("hpnd", "publicity", "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("ntp", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("isc", "isc", "(licensed|released) under (the )?isc"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties"),
    ("0bsd", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("curl", "copyright", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("icu", "unicode", "copyright c 1991( [0-9]{4})? unicode inc all rights reserved"),
    ("unicode", "unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("fair", "usage", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("fsfap", "copying", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsful", "unlimited", "the free software foundation gives unlimited permission to copy and or distribute it"),
    ("tcl", "hereby", "the authors hereby grant permission to use copy modify distribute and license this software"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("beerware", "beer", "the beer ware license"),
    ("wtfpl", "just", "0 you just do what the fuck you want to"),
    ("wtfpl", "everyone", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("smlnj", "jersey", "standard ml of new jersey copyright license notice disclaimer and license"),
    ("w3c", "w3c", "w3c software (notice and license|and document notice and license)"),
    ("w3c", "obtaining", "by obtaining using and or copying this work you the licensee agree"),
    ("vim", "vim", "vim is charityware"),
    ("vim", "donation", "you can use and copy it as much as you like but you are encouraged to make a donation"),
    ("pil", "pil", "the python imaging library pil is"),
    ("boehm", "permission", "permission is hereby granted to use or copy this program for any purpose provided the above notices are retained on all copies"),
    ("linux-man", "manual", "permission is granted to make and distribute verbatim copies of this manual"),
    ("spencer", "permission", "permission is granted to anyone to use this software for any purpose on any computer system"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("zlib", "arising", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "notice", "this notice may not be removed or altered from any source distribution"),
    ("libpng", "png", "the png reference library is supplied as is"),
    ("libtiff", "leffler", "the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("ijg", "independent", "this software is based in part on the work of the independent jpeg group"),
    ("bzip2", "bzip2", "this program bzip2 the associated library libbzip2"),
    ("info-zip", "info", "info zip is defined as the following set of individuals"),
    ("openldap", "openldap", "the openldap public license"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("php", "php", "this product includes php software freely available from"),
    ("zend", "zend", "this product includes the zend engine freely available"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache", "this product includes software developed by the apache group"),
    ("xfree86", "xfree86", "this product includes software developed by the xfree86 project"),
    ("jasper", "jasper", "jasper license version 2 0"),
    ("naumen", "naumen", "naumen public license"),
    # BSD family
    ("bsd-2-clause", "retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "contributors", "neither the names? of the copyright holders? nor the names of (its|the|any) contributors may be used"),
    ("bsd-3-clause", "university", "neither the name of the university nor the names of its contributors"),
    ("bsd-3-clause", "author", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "university", "this product includes software developed by the university of california"),
    ("bsd-4-clause", "acknowledgment|acknowledgement", "must display the following acknowledge?ment"),
    ("bsd", "merchantability", "but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "exemplary", "be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "bsd", "(licensed|released|distributed) under (the |a )?(terms of the )?bsd( style)?"),
    ("bsd", "bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-patent", "patent", "bsd 2 clause plus patent"),
    ("bsd-3-clause-lbnl", "obligation", "you are under no obligation whatsoever to provide any bug fixes patches or upgrades"),
    ("bsd-protection", "bsd", "bsd protection license"),
    ("bsd-source-code", "source", "redistributions of source code must retain all copyright notices"),
    ("nuclear", "nuclear", "software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("ncsa", "university", "developed by (the )?university of illinois"),
    ("ncsa", "deal", "to deal with the software without restriction including without limitation"),
    # GPL family
    ("gpl", "gpl", "(licensed|released|distributed) under (the )?(terms of the )?(gnu )?gpl"),
    ("gpl", "useful", "is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with"),
    ("gpl", "foundation", "write to the free software foundation inc"),
    ("gpl-2.0", "june", "gnu general public license version 2 june 1991"),
    ("gpl-2.0", "gplv2", "gplv2"),
    ("gpl-2.0-or-later", "option", "either version 2 of the license or at your option any later version"),
    ("gpl-2.0-only", "only", "under the terms of (the )?gnu general public license version 2 only"),
    ("gpl-2.0", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "june", "gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", "gplv3", "gplv3"),
    ("gpl-3.0-or-later", "option", "either version 3 of the license or at your option any later version"),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "convey", "you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-1.0", "february", "gnu general public license version 1 february 1989"),
    ("gpl-classpath-exception", "linking", "linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-classpath-exception", "classpath", "gnu general public license .{0,30}? ?with (the )?classpath exception"),
    ("gpl-gcc-exception", "gcc", "gcc runtime library exception"),
    ("gpl-font-exception", "embed", "if you create a document which uses this font and embed this font"),
    ("gpl-bison-exception", "bison", "you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-autoconf-exception", "autoconf", "a configuration script generated by autoconf"),
    ("gpl-linking-exception", "openssl", "permission to link the code of portions of this program with the openssl library"),
    ("lgpl", "lgpl", "(licensed|released|distributed) under (the )?(terms of the )?(gnu )?lgpl"),
    ("lgpl", "received", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl-2.1", "february", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.1", "lgplv2", "lgplv2( 1)?"),
    ("lgpl-2.0", "june", "gnu library general public license version 2 june 1991"),
    ("lgpl-3.0", "supplemented", "incorporates the terms and conditions of version 3 of the gnu general public license supplemented by"),
    ("lgpl-3.0", "lgplv3", "lgplv3"),
    ("agpl-3.0", "november", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", "agplv3", "agplv3"),
    ("agpl-3.0", "interacting", "users interacting with it remotely through a computer network"),
    ("agpl-1.0", "affero", "affero general public license version 1"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("sleepycat", "sleepycat", "(the )?sleepycat license"),
    ("sleepycat", "accompanying", "information on how to obtain complete source code for the db software and any accompanying software"),
    ("sspl-1.0", "service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("copyleft-next", "copyleft", "copyleft next"),
    # Apache, Mozilla, Eclipse and other foundations
    ("apache-2.0", "apache", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "january", "apache license version 2 0 january 2004"),
    ("apache-2.0", "foundation", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "limitations", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "basis", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "apachev2", "apachev2"),
    ("ecl-2.0", "educational", "educational community license( version)? 2 0"),
    ("ecl-1.0", "educational", "educational community license( version)? 1 0"),
    ("mpl-1.0", "mozilla", "mozilla public license version 1 0"),
    ("mpl-1.1", "contents", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "obtain", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "incompatible", "this source code form is incompatible with secondary licenses"),
    ("npl-1.1", "netscape", "netscape public license"),
    ("mpl-tri-license", "alternatively", "alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("edl-1.0", "eclipse", "eclipse distribution license( v| version)? ?1 0"),
    ("epl", "recipient", "constitutes recipient s acceptance of this agreement"),
    ("cddl-1.0", "development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.1", "cddl|distribution", "common development and distribution license( cddl)? version 1 1"),
    ("cpl-1.0", "common", "the accompanying program is provided under the terms of this common public license"),
    ("cpal-1.0", "common", "common public attribution license"),
    ("apsl-2.0", "apple", "apple public source license( version)?( 2 0)?"),
    ("apsl-2.0", "apple", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("aal", "attribution", "attribution assurance license"),
    ("artistic-1.0", "artistic", "the artistic license preamble"),
    ("artistic-2.0", "artistic", "the artistic license 2 0 copyright"),
    ("perl", "perl", "you can redistribute it and or modify it under the same terms as perl"),
    ("perl", "perl|perl5", "same terms as (the )?perl ?5? programming language"),
    ("psf-2.0", "python", "python software foundation license version 2"),
    ("psf-2.0", "psf", "psf license agreement for python"),
    ("cnri-python", "cnri", "cnri open source license agreement"),
    ("ruby", "bsdl", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("zpl-2.1", "zope", "zope public license( zpl)?( version)?( 2 1)?"),
    ("lppl-1.3", "latex", "latex project public license"),
    ("lppl-1.3", "latex", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("nasa-1.3", "nasa", "nasa open source agreement"),
    ("rpl-1.5", "reciprocal", "reciprocal public license"),
    ("sissl", "sun", "sun industry standards source license"),
    ("spl-1.0", "sun", "sun public license"),
    ("bcl", "binary", "(sun microsystems inc|oracle) binary code license agreement"),
    ("watcom-1.0", "watcom", "sybase open watcom public license"),
    ("catosl", "computer", "computer associates trusted open source license"),
    ("lpl-1.02", "lucent", "lucent public license"),
    ("nokia", "nokia", "nokia open source license"),
    ("realnetworks", "realnetworks", "realnetworks public source license"),
    ("ricoh", "ricoh", "ricoh source code public license"),
    ("sugarcrm", "sugarcrm", "sugarcrm public license"),
    ("motosoto", "motosoto", "motosoto open source license"),
    ("eudatagrid", "datagrid", "eu datagrid software license"),
    ("entessa", "entessa", "entessa public license"),
    ("frameworx", "frameworx", "frameworx open license"),
    ("intel", "intel", "intel open source license"),
    ("intel-simplified", "intel", "intel simplified software license"),
    ("mulanpsl-2.0", "mulan", "(mulan psl v ?2|mulan permissive software license version 2)"),
    ("blueoak-1.0", "blue", "blue oak model license"),
    ("polyform-noncommercial", "polyform", "polyform noncommercial license"),
    ("polyform-small-business", "polyform", "polyform small business license"),
    ("polyform-shield", "polyform", "polyform shield license"),
    ("prosperity", "prosperity", "the prosperity public license"),
    ("parity", "parity", "the parity public license"),
    ("hippocratic", "hippocratic", "hippocratic license"),
    ("commons-clause", "commons", "commons clause license condition"),
    ("commons-clause", "sell", "the license does not grant to you the right to sell the software"),
    ("confluent", "confluent", "confluent community license( agreement)?"),
    ("rsal", "redis", "redis source available license"),
    ("timescale", "timescale", "timescale license agreement"),
    ("busl-1.1", "change", "change license .{0,40}? ?additional use grant"),
    ("elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    # content, data, fonts and models
    ("cc-by", "creative", "this work is licensed under (a |the )?creative commons attribution"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(atives|s)"),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights to this work"),
    ("cc0-1.0", "dedicated", "has dedicated the work to the public domain by waiving"),
    ("cc-pdm", "mark", "public domain mark 1 0"),
    ("public-domain", "domain", "this (file|code|work|software) is (hereby )?(in|placed in|placed into) the public domain"),
    ("public-domain", "disclaim|disclaims", "the author(s)? disclaims? copyright to this source code"),
    ("public-domain", "government", "work of the (united states|u s) government"),
    ("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("odc-by", "attribution", "open data commons attribution license"),
    ("odbl-1.0", "database", "this (database|data) is made available under the open database license"),
    ("cdla-permissive", "community", "community data license agreement permissive"),
    ("cdla-sharing", "community", "community data license agreement sharing"),
    ("ogl-uk", "government", "contains public sector information licensed under the open government licence"),
    ("ogl-uk", "government", "open government licence( v| version)?( ?[123] 0)?"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "reserved", "no modified version of the font software may use the reserved font name"),
    ("ubuntu-font", "ubuntu", "ubuntu font licen[cs]e"),
    ("bitstream-vera", "vera", "bitstream vera is a trademark of bitstream"),
    ("free-art", "art", "free art license"),
    ("design-science", "design", "design science license"),
    ("open-publication", "publication", "open publication license"),
    ("openrail", "openrail|rail|open|creativeml", "(creativeml )?open ?rail( m| s)? license"),
    ("openrail", "openrail", "bigscience openrail m"),
    ("llama", "llama", "llama [23] community license( agreement)?"),
    ("gemma", "gemma", "gemma terms of use .{0,40}? ?license"),
    # restrictions
    ("noncommercial", "noncommercial|commercial", "for (personal and )?non ?commercial (use|purposes) only"),
    ("noncommercial", "commercial", "may not be used for commercial purposes"),
    ("research-only", "research|academic", "for (academic|research) (and research )?(use|purposes) only"),
    ("evaluation-only", "evaluation", "for (internal )?evaluation (use|purposes) only"),
    ("proprietary", "written", "without the (express |prior )?(express |prior )?written (consent|permission) of the (author|copyright (holder|owner)|publisher|company)"),
    ("proprietary", "reproduced", "no part of this (publication|book|document|work|software) may be reproduced"),
    ("proprietary", "trade", "contains (confidential information and )?trade secrets"),
    ("proprietary", "end", "end user license agreement"),
    ("proprietary", "licensed", "this software is licensed not sold"),
    ("proprietary", "reverse", "you may not reverse engineer decompile or disassemble"),
    ("proprietary", "commercial", "(this|the) software is (a )?commercial (product|software)"),
    ("ms-eula", "microsoft", "microsoft software license terms"),
    ("ms-lpl", "microsoft", "microsoft limited public license"),
    ("nvidia", "nvidia", "nvidia (corporation and its licensors retain all intellectual property|software license agreement)"),
    ("amd", "micro", "advanced micro devices inc .{0,40}? ?license"),
    ("other-copyleft", "applies", "this license applies to any program or other work which contains a notice"),
    ("other-open-source", "osi", "osi (approved|certified) (open source )?licen[cs]e"),
    ("other-open-source", "open", "open source license see (the )?(license|copying) file"),
    ("file-reference", "copying", "see (the )?(file )?copying (file )?(for|in) .{0,40}? ?(license|details|terms)"),
    ("file-reference", "license", "see (the )?(file )?license( md| txt)? (file )?(in the (project )?root|for (details|more information|the full license))"),
    ("file-reference", "license", "license that can be found in the license file"),
    ("notice", "notice", "see the notice file distributed with this work for additional information regarding copyright ownership"),
    ("dual-license", "dual", "dual licensed under"),
    ("cla", "contributor", "contributor license agreement"),
    ("dco", "developer", "developer certificate of origin"),
    ("copyright-statement", "copyright", "copyright (c )?(19|20)[0-9]{2}( (19|20)[0-9]{2})? .{1,60}? all rights reserved"),
]

#: label, phrase of the base detections
BASE = [("mit", "mit"), ("apache", "apache"), ("gpl", "general public")]

RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE = " (?:" + "|".join(p for _, p in BASE) + ") (?=license )"


def rules() -> list[tuple[str, str, str, int, float]]:
    """label, keywords (parted by |), regex over the text's words (a blank on either side), priority (0 first), weight."""
    out, under = [], "under (?:the )?(?:terms of )?(?:the )?"
    for label, keyword, name, spdx, address in LICENSES:
        out.append((label, "spdx", rf" spdx license identifier {spdx}(?: or later| only)?(?= )", 0, 0.99))
        out.append((label, address.split(" ")[0], rf" {address}(?= )", 1, 0.97))
        out.append((label, keyword, rf" (?:licensed {under}{name}(?: license)?|(?:released|distributed|available|published|provided|covered) {under}{name} license)(?= )", 2, 0.95))
        tail = "(?= )" if "licen" in name else "(?: software)? licen[cs]e(?= )"
        out.append((label, keyword, rf" {name}{tail}", 3, 0.8))
    for label, keyword, sentence in SENTENCES:
        out.append((label, keyword, rf" {sentence}(?= )", 2, 0.9))
    return out


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _detect(words: Column, rule: Column) -> Column:
    """All intervals of one rule."""

    def item(start: Column, end: Column, _: Column) -> Column:
        return F.struct(start.alias("s"), (-end).alias("e"), rule["priority"].alias("p"), rule["label"].alias("label"), rule["weight"].alias("weight"))

    return matches(words, rule["regex"], item, "struct<s:int,e:int,p:int,label:string,weight:double>")


def _resolve(found: Column) -> Column:
    """The labels and the best weight of the detections that stand.

    Detections are passed in the order of start, longer ones first. One that
    lies inside the one that stands is suppressed; of two that overlap in part
    the one of better priority stands, the earlier on ties.
    """
    none = F.array().cast("array<string>")

    def close(acc: Column) -> tuple[Column, Column]:
        shut = acc["end"] < 0
        labels = F.when(shut, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(acc["label"])))
        return labels, F.greatest(acc["score"], acc["weight"])

    def step(acc: Column, d: Column) -> Column:
        apart, wins = d["s"] >= acc["end"], d["p"] < acc["p"]
        inside = -d["e"] <= acc["end"]
        new = apart | (wins & ~inside)
        labels, score = close(acc)
        pick = lambda a, b: F.when(new, a).otherwise(b)
        return F.struct(
            pick(-d["e"], acc["end"]).alias("end"), pick(d["p"], acc["p"]).alias("p"), pick(d["label"], acc["label"]).alias("label"),
            pick(d["weight"], acc["weight"]).alias("weight"), F.when(apart, labels).otherwise(acc["labels"]).alias("labels"),
            F.when(apart, score).otherwise(acc["score"]).alias("score"),
        )

    start = F.struct(
        F.lit(-1).alias("end"), F.lit(99).alias("p"), F.lit("").alias("label"), F.lit(0.0).alias("weight"), none.alias("labels"), F.lit(0.0).alias("score")
    )

    def end(acc: Column) -> Column:
        labels, score = close(acc)
        return F.struct(labels.alias("labels"), score.alias("score"))

    return F.aggregate(F.array_sort(found), start, step, end)


def by_keyword() -> dict[str, list[tuple[str, str, int, float]]]:
    """The rules (label, regex, priority, weight) of every keyword; the word of the base phrases has none."""
    out: dict[str, list] = {"license": []}
    for label, keywords, regex, priority, weight in rules():
        for k in keywords.split("|"):
            out.setdefault(k, []).append((label, regex, priority, weight))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Each row with n_words, n_base, first_word, last_word, base_labels, labels and score; columns of these names are replaced."""
    table = by_keyword()
    none = F.array().cast("array<struct<label:string,regex:string,priority:int,weight:double>>")
    rule = lambda a, b, c, d: F.struct(F.lit(a).alias("label"), F.lit(b).alias("regex"), F.lit(c).alias("priority"), F.lit(d).alias("weight"))
    lookup = F.create_map(*[x for k, found in table.items() for x in (F.lit(k), F.array(*[rule(*r) for r in found]) if found else none)])
    keep = [docs[c] for c in docs.columns if c not in RESULTS]
    plain = F.trim(F.regexp_replace(fold_ascii(whole_text()), _BREAKS, " "))
    rows = docs.select(F.struct(*keep).alias("_doc"), plain.alias("_t"))
    rows = rows.select("_doc", "_t", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", " ")).alias("_words"))
    rows = rows.select("_doc", F.size("_words").cast("long").alias("n_words"), "_t", F.array_intersect("_words", F.array(*map(F.lit, table))).alias("_keys"))
    rows = rows.select("_doc", "n_words", "_keys", F.when(F.size("_keys") > 0, F.concat(F.lit(" "), "_t", F.lit(" "))).alias("_w"))
    rows = rows.withColumn("_gaps", F.split("_w", _BASE, -1)).withColumn("_hits", F.regexp_extract_all("_w", F.lit(_BASE), F.lit(0)))
    n = F.coalesce(F.size("_hits"), F.lit(0))
    any_base = F.col("_w").isNotNull() & (n > 0)
    label_of = F.create_map(*[F.lit(x) for label, phrase in BASE for x in (f" {phrase} ", label)])
    rows = rows.select(
        "_doc",
        "n_words",
        F.when(any_base, n).otherwise(0).cast("long").alias("n_base"),
        F.when(any_base, _spaces(F.get("_gaps", F.lit(0)))).cast("long").alias("first_word"),
        F.when(
            any_base,
            F.col("n_words") + 1 - _spaces(F.element_at("_hits", -1)) - _spaces(F.element_at("_gaps", -1)),
        ).cast("long").alias("last_word"),
        F.when(any_base, F.array_distinct(F.transform("_hits", lambda x: label_of[x]))).otherwise(F.array().cast("array<string>")).alias("_base"),
        F.when(F.col("_w").isNotNull(), F.array_distinct(F.flatten(F.transform("_keys", lambda k: lookup[k])))).alias("_rules"),
        "_w",
    )
    found = F.flatten(F.transform("_rules", lambda r: _detect(F.col("_w"), r)))
    rows = rows.withColumn("_out", F.when(F.size("_rules") > 0, _resolve(found)))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    none = F.array().cast("array<string>")
    return rows.select(
        "_doc.*", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("_base")).alias("base_labels"),
        joined(F.array_union(F.col("_base"), F.coalesce(F.col("_out.labels"), none))).alias("labels"),
        F.greatest(F.coalesce(F.col("_out.score"), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.7).otherwise(0.0)).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")


QUERIES = {"op10_licenses": op10_licenses}
SQL: dict[str, str] = {}
