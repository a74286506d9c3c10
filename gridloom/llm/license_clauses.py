"""More clauses of licenses, written by hand: label and pattern, license by license.  A space is any white space and comment marks."""

from __future__ import annotations

CLAUSES = (
    # copyleft of the GNU family, section by section
    ("gpl-2.0", r"you may copy and distribute verbatim copies of the program's source code as you receive it"),
    ("gpl-2.0", r"you must cause the modified files to carry prominent notices stating that you changed the files"),
    ("gpl-2.0", r"accompany it with the complete corresponding machine-readable source code"),
    ("gpl-2.0", r"each time you redistribute the program (?:\(or any work based on the program\))?,? ?the recipient automatically receives a license"),
    ("gpl-2.0", r"you are not required to accept this license, since you have not signed it"),
    ("gpl-2.0", r"mere aggregation of another work not based on the program with the program"),
    ("gpl-2.0", r"gnomovision version 69, copyright"),
    ("gpl-2.0", r"yoyodyne, inc\., hereby disclaims all copyright interest in the program"),
    ("gpl-3.0", r"conveying verbatim copies of the program's source code"),
    ("gpl-3.0", r"the .?corresponding source.? for a work in object code form means all the source code needed"),
    ("gpl-3.0", r"no covered work shall be deemed part of an effective technological measure"),
    ("gpl-3.0", r"a .?user product.? is either \(1\) a .?consumer product"),
    ("gpl-3.0", r"installation information.? for a user product means any methods, procedures, authorization keys"),
    ("gpl-3.0", r"each contributor grants you a non-exclusive, worldwide, royalty-free patent license under the contributor's essential patent claims"),
    ("gpl-3.0", r"no surrender of others' freedom"),
    ("gpl", r"this program comes with absolutely no warranty; for details type"),
    ("gpl", r"this is free software, and you are welcome to redistribute it under certain conditions"),
    ("gpl", r"the hypothetical commands .show w. and .show c. should show the appropriate parts"),
    ("gpl", r"the gnu general public license does not permit incorporating your (?:sub)?program into proprietary programs"),
    ("gpl-1.0", r"either version 1, or \(at your option\) any later version"),
    ("gpl-1.0", r"the license agreements of most software companies try to keep users at the mercy of those companies"),
    ("lgpl-2.0", r"gnu library general public license version 2, june 1991"),
    ("lgpl-2.1", r"this is the first released version of the lesser gpl"),
    ("lgpl-2.1", r"a .?work that uses the library.? is not a derivative"),
    ("lgpl-2.1", r"facilities that depend on a function or a table of data to be supplied by an application program"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl-3.0", r"the .?minimal corresponding source.? for a combined work"),
    ("lgpl-3.0", r"use a suitable shared library mechanism for linking with the library"),
    ("agpl-3.0", r"your modified version must prominently offer all users interacting with it remotely"),
    ("agpl-1.0", r"affero general public license version 1, march 2002"),
    ("gfdl", r"a .?secondary section.? is a named appendix or a front-matter section of the document"),
    ("gfdl", r"any section entitled .?endorsements.?\. such a section may not be included in the modified version"),
    ("font-exception-2.0", r"as a special exception, if you create a document which uses this font, and embed this font"),
    ("libtool-exception", r"if you distribute this file as part of a program or library that is built using gnu libtool"),
    ("ocaml-lgpl-linking-exception", r"you may link, statically or dynamically, a .?work that uses the library.? with a publicly distributed version of the library"),
    ("fltk-exception", r"modifications to the fltk configure script, config header file, and makefiles"),
    ("wxwindows", r"wxwindows library licence, version 3"),
    ("wxwindows", r"the copyright holders? of this library give permission for additional uses of the text contained in this release"),
    ("linux-syscall-note", r"this copyright does \*?not\*? cover user programs that use kernel services by normal system calls"),
    ("fsfap", r"copying and distribution of this file, with or without modification, are permitted in any medium without royalty"),
    ("fsful", r"this configure script is free software; the free software foundation gives unlimited permission to copy, distribute and modify it"),
    ("fsfullr", r"this file is free software; the free software foundation gives unlimited permission to copy and/or distribute it"),
    # permissive notices of universities and companies
    ("mit-0", r"permission is hereby granted, free of charge, .{0,220}? to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("mit-cmu", r"the name of (?:carnegie mellon university|cmu|.{1,60}?) not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission"),
    ("mit-advertising", r"the above copyright notice and this permission notice shall be included in all .{0,80}? and .{0,40}?acknowledge?ment shall be"),
    ("mit-feh", r"shall be included in all copies of the software and its documentation and acknowledgment shall be given in the documentation"),
    ("mitnfa", r"distributions of all or part of the software intended to be used by the recipients as they would use the unmodified software"),
    ("x11", r"except as contained in this notice, the name of the x consortium shall not be used"),
    ("x11", r"x window system is a trademark of x consortium"),
    ("xfree86-1.1", r"this product includes software developed by the xfree86 project"),
    ("hpnd-sell", r"permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("ntp", r"the university makes no representations about the suitability of this software for any purpose"),
    ("ntp", r"the name of the university of delaware not be used in advertising"),
    ("dec", r"digital equipment corporation (?:makes no representations about the suitability|disclaims all warranties with regard)"),
    ("libtiff", r"the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("rsa-md", r"license to copy and use this software is granted provided that it is identified as the .?rsa data security"),
    ("rsa-md", r"derived from the rsa data security, inc\. md[245] message-digest algorithm"),
    ("sunpro", r"developed at sunpro, a sun microsystems, inc\. business"),
    ("sun-rpc", r"sun rpc is a product of sun microsystems, inc\. and is provided for unrestricted use"),
    ("smlnj", r"standard ml of new jersey copyright notice, license and disclaimer"),
    ("tcl", r"the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose"),
    ("tcl", r"existing copyright notices are retained in all copies and that this notice is included verbatim in any distributions"),
    ("gnuplot", r"permission to distribute the released version of the source code along with corresponding source modifications in the form of a patch file"),
    ("isc", r"isc disclaims all warranties with regard to this software including all implied warranties"),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bind", r"internet (?:systems|software) consortium disclaims all warranties"),
    ("tcp-wrappers", r"this copyright notice must not be removed .{0,60}?wietse venema"),
    ("tcp-wrappers", r"portions of this material resulted from the use of .{0,40}?wietse venema"),
    ("netcdf", r"university corporation for atmospheric research/unidata"),
    ("netcdf", r"unidata requests that all .{0,40}?users .{0,80}? acknowledge the contribution of unidata"),
    ("snprintf", r"this code is based on code written by patrick powell"),
    ("spencer-86", r"permission is granted to anyone to use this software for any purpose on any computer system, and to (?:alter it and )?redistribute it"),
    ("spencer-86", r"the author is not responsible for the consequences of use of this software, no matter how awful"),
    ("spencer-94", r"this software is not subject to any license of the american telephone and telegraph company"),
    ("bzip2-1.0.6", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software .{0,160}?julian seward"),
    ("bzip2-1.0.6", r"this program, .?bzip2.?, the associated library .?libbzip2"),
    ("info-zip", r"info-zip retains the right to use the names .?info-zip"),
    ("unrar", r"unrar sources may be used in any software to handle rar archives"),
    ("unrar", r"cannot be used to re-create the rar compression algorithm"),
    ("lzma-sdk", r"lzma sdk is (?:written and )?placed in the public domain by igor pavlov"),
    ("jasper-2.0", r"jasper license version 2\.0"),
    ("jasper-2.0", r"the software is not fault-tolerant and is not intended for use in mission-critical systems"),
    ("libpng-2.0", r"libpng versions .{1,60}? are copyright .{1,120}? and are distributed according to the same disclaimer and license"),
    ("libpng-2.0", r"the contributing authors and group 42, inc\. disclaim all warranties"),
    ("ijg", r"the authors make no warranty or representation, either express or implied, with respect to this software, its quality, accuracy"),
    ("ijg", r"permission is hereby granted to use, copy, modify, and distribute this software \(or portions thereof\) for any purpose, without fee"),
    ("freetype", r"the freetype project is copyright \(c\) 1996-2000 by david turner"),
    ("freetype", r"we .?don't promise that this software works"),
    ("leptonica", r"redistributions .{0,80}?leptonica"),
    ("leptonica", r"copyright \(c\) 2001 leptonica"),
    ("qhull", r"qhull, copyright \(c\) 1993-\d{4}"),
    ("qhull", r"all copyright notices must remain intact in all files .{0,200}? qhull"),
    ("icu", r"copyright \(c\) 1995-\d{4} international business machines corporation and others"),
    ("unicode-dfs", r"permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files"),
    ("unicode-dfs", r"unicode data files include all data files under the directories"),
    ("w3c", r"permission to copy, modify, and distribute this software and its documentation, with or without modification, for any purpose and without fee or royalty is hereby granted"),
    ("w3c", r"the name and trademarks of copyright holders may not be used in advertising or publicity pertaining to the software"),
    ("w3c-19980720", r"the full text of this notice in a location viewable to users of the redistributed or derivative work"),
    ("xnet", r"this agreement shall be governed in all respects by the laws of the state of california and by the laws of the united states"),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works"),
    ("bahyph", r"these patterns were developed for internal gmv use and are made public"),
    ("miros", r"provided that these terms and disclaimer and all copyright notices are retained or reproduced in an accompanying document"),
    ("giftware", r"allegro is gift-ware"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("imlib2", r"acknowledgment shall be given in the documentation and software packages that this software was used"),
    ("newlib", r"the newlib subdirectory is a collection of software from several sources"),
    ("intel-acpi", r"intel grants, free of charge, to any person .{0,40}?obtaining a copy of the source code appearing in this file"),
    ("cmu-mach", r"carnegie mellon (?:university )?allows free use of this software in its .as is. condition"),
    ("cmu-mach", r"carnegie mellon requests users of this software to return to"),
    ("naist-2003", r"nara institute of science and technology .{0,40}?\(naist\), disclaims all warranties"),
    ("nrl", r"this product includes software developed at the information technology division, us naval research laboratory"),
    ("lucent-plan9", r"permission to use, copy, modify, and distribute this software for any purpose without fee is hereby granted, provided that this entire notice is included in all copies"),
    # advertising and endorsement in the Berkeley family
    ("bsd-2-clause", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-2-clause", r"the views and conclusions .{0,60}?should not be interpreted as representing official policies, either expressed or implied, of the freebsd project"),
    ("bsd-2-clause-netbsd", r"this code is derived from software contributed to the netbsd foundation by"),
    ("bsd-2-clause-patent", r"subject to the terms and conditions of this license, each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("bsd-3-clause-lbnl", r"you are under no obligation whatsoever to provide any bug fixes, patches, or upgrades to the features, functionality or performance"),
    ("bsd-3-clause-no-nuclear", r"you acknowledge that this software is not designed, licensed or intended for use in the design, construction, operation or maintenance of any nuclear facility"),
    ("bsd-3-clause-open-mpi", r"the copyright holders provide no reassurances that the source code provided does not infringe any patent"),
    ("bsd-4-clause-uc", r"neither the name of the university nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause-shortened", r"redistribution and use .{0,200}? provided that: \(1\) source code distributions retain the above copyright notice"),
    ("bsd-source-code", r"redistribution and use of this software in source form, with or without modification"),
    ("bsd-protection", r"bsd protection license"),
    ("0bsd", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided"),
    ("openldap-2.8", r"the openldap public license version 2\.8"),
    ("openldap-2.8", r"the openldap foundation may revise this license from time to time"),
    ("openldap-2.8", r"title to copyright in this software shall at all times remain with copyright holders"),
    ("ssleay", r"this package is an ssl implementation written by eric young"),
    ("ssleay", r"the implementation was written so as to conform with netscapes ssl"),
    ("ssleay", r"the licence and distribution terms for any publi[ck]ally available version or derivative of this code cannot be changed"),
    ("openssl", r"the names .?openssl toolkit.? and .?openssl project.? must not be used to endorse"),
    ("openssl", r"the openssl toolkit stays under a dual license"),
    ("apache-1.0", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-1.1", r"the names .?apache.? and .?apache software foundation.? must not be used to endorse or promote products"),
    ("apache-2.0", r"derivative works thereof, that is intentionally submitted to licensor for inclusion in the work"),
    ("apache-2.0", r"if you institute patent litigation against any entity \(including a cross-claim or counterclaim in a lawsuit\)"),
    ("apache-2.0", r"to apply the apache license to your work, attach the following boilerplate notice"),
    ("apache-2.0", r"see the notice file distributed with this work for additional information regarding copyright ownership"),
    ("ecl-2.0", r"any .?educational community.? license"),
    ("ecl-2.0", r"the educational community license version 2\.0 .{0,40}?consists of the apache 2\.0 license"),
    ("php-3.01", r"the php group may publish revised and/or new versions of the license from time to time"),
    ("php-3.01", r"products derived from this software may not be called .?php"),
    ("zend-2.0", r"this product includes the zend engine, freely available at"),
    ("python-cnri", r"cnri is making python .{0,20}?available to licensee on an .as is. basis"),
    ("python-cnri", r"cnri hereby grants licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test"),
    ("beopen", r"beopen is making the software available to licensee on an .as is. basis"),
    ("cwi", r"stichting mathematisch centrum disclaims all warranties with regard to this software"),
    ("zpl-2.1", r"names of the copyright holders must not be used to endorse or promote products derived from this software without prior written permission .{0,120}?zope"),
    ("zpl-2.1", r"this license has been certified as open source\. it has also been designated as gpl compatible"),
    ("egenix-1.1.0", r"egenix\.com public license agreement"),
    ("condor-1.1", r"this software referred to as the condor.{0,4}? version"),
    ("globus", r"globus toolkit public license"),
    ("eudatagrid", r"this product includes software developed by the eu datagrid"),
    ("entessa", r"this product includes open source software developed by openseal"),
    ("naumen", r"this product includes software developed by naumen"),
    ("plexus", r"for more information about jaxen, please visit"),
    ("plexus", r"this software consists of voluntary contributions made by many individuals .{0,80}?(?:plexus|codehaus)"),
    ("vsl-1.0", r"vovida software license"),
    ("vsl-1.0", r"vocal, vovida open communication application library"),
    ("saxpath", r"this product includes software developed by the saxpath project"),
    ("sleepycat", r"for an executable file, complete source code means the source code for all modules it contains"),
    # weak copyleft of companies and foundations
    ("mpl-1.1", r"the initial developer of the original code is"),
    ("mpl-1.1", r"alternatively, the contents of this file may be used under the terms of either the gnu general public license version 2 or later"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("mpl-2.0", r"each contributor represents that the contributor believes its contributions are its original creation"),
    ("mpl-2.0", r"larger work.? means a work that combines covered software with other material, in a separate file or files"),
    ("mpl-2.0", r"you may add additional accurate notices of copyright ownership"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public license"),
    ("cddl-1.0", r"when distributing covered code, include this cddl header in each file"),
    ("cddl-1.0", r"you can obtain a copy of the license at .{0,40}?opensolaris\.license"),
    ("cddl-1.1", r"you can obtain a copy of the license at .{0,60}?glassfish"),
    ("sissl", r"sun industry standards source license"),
    ("spl-1.0", r"sun public license notice"),
    ("epl-1.0", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-2.0", r"exhibit a .{0,4}?form of secondary licenses notice"),
    ("edl-1.0", r"eclipse distribution license"),
    ("cpl-1.0", r"a contributor may choose to distribute the program in object code form under its own license agreement"),
    ("ipl-1.0", r"the accompanying program is provided under the terms of this ibm public license"),
    ("apsl-2.0", r"this file contains original code and/or modifications of original code as defined in and that are subject to the apple public source license"),
    ("aml", r"in consideration of your agreement to abide by the following terms, and subject to these terms, apple grants you a personal, non-exclusive license"),
    ("aml", r"disclaimer: important: ?this apple software is supplied to you by apple"),
    ("nokia", r"nokia open source license"),
    ("rpsl-1.0", r"realnetworks public source license"),
    ("sgi-b-2.0", r"sgi free software license b"),
    ("sugarcrm-1.1.3", r"sugarcrm public license"),
    ("zimbra-1.3", r"zimbra public license"),
    ("yahoo-ypl", r"yahoo! public license"),
    ("cua-opl-1.0", r"cua office public license"),
    ("interbase-1.0", r"interbase public license"),
    ("firebird-idpl", r"initial developer's public license version 1\.0"),
    ("erlpl-1.1", r"erlang public license"),
    ("motosoto", r"motosoto open source license"),
    ("frameworx-1.0", r"frameworx open license"),
    ("oclc-2.0", r"oclc research public license"),
    ("osl-3.0", r"licensed under the open software license version \d\.\d"),
    ("osl-3.0", r"licensor hereby grants you a worldwide, royalty-free, non-exclusive, sublicensable license, for the duration of the copyright"),
    ("afl-3.0", r"licensed under the academic free license version \d\.\d"),
    ("afl-3.0", r"this academic free license .{0,40}?applies to any original work of authorship"),
    ("nposl-3.0", r"non-profit open software license"),
    ("eupl-1.1", r"licensed under the eupl,? version 1\.1"),
    ("eupl-1.2", r"licensed under the eupl,? (?:version 1\.2|with extension of article 5)"),
    ("eupl", r"this european union public licence .{0,40}?applies to the work"),
    ("cecill-2.1", r"this software is governed by the cecill(?:-[abc])? license under french law and abiding by the rules of distribution of free software"),
    ("cecill-2.1", r"as a counterpart to the access to the source code and rights to copy, modify and redistribute granted by the license"),
    ("liliq", r"licence libre du qu[eé]bec"),
    ("d-fsl-1.0", r"deutsche freie software lizenz"),
    ("nlod-1.0", r"norsk lisens for offentlige data"),
    ("gsoap-1.3b", r"the contents of this file are subject to the gsoap public license"),
    ("trolltech-qpl", r"the q public license version 1\.0 .{0,60}?trolltech"),
    ("ogtsl", r"open group test suite license"),
    ("lppl-1.3c", r"this work may be distributed and/or modified under the conditions of the latex project public license"),
    ("lppl-1.3c", r"this work has the lppl maintenance status"),
    ("lppl-1.3c", r"the current maintainer of this work is"),
    ("knuth", r"you may copy this file provided that you make absolutely no changes .{0,120}?donald"),
    ("knuth", r"this file may be freely copied and distributed, provided that no changes whatsoever are made"),
    ("artistic-1.0", r"copyright holder.? is whoever is named in the copyright or copyrights for the package"),
    ("artistic-1.0", r"the scripts and library files supplied as input to or produced as output from the programs of this package do not automatically fall under the copyright of this package"),
    ("clartistic", r"clarified artistic license"),
    ("artistic-2.0", r"you may distribute verbatim copies of the source form of the standard version of this package"),
    ("ruby", r"you may redistribute it and/or modify it under either the terms of the (?:gpl|2-clause bsdl)"),
    ("vim", r"you can use and copy it as much as you like, but you are encouraged to make a donation for needy children in uganda"),
    ("nethack", r"nethack general public license"),
    ("multics", r"this edition of the multics software materials and documentation is provided and donated to massachusetts institute of technology"),
    ("aladdin", r"aladdin free public license"),
    ("afpl", r"aladdin enterprises hereby grants to anyone the permission to apply this license"),
    # fonts, documents, data and works of art
    ("ofl-1.1", r"reserved font name.? refers to any names specified as such after the copyright statement"),
    ("ofl-1.1", r"neither the font software nor any of its individual components, in original or modified versions, may be sold by itself"),
    ("ofl-1.0", r"sil open font license version 1\.0"),
    ("ubuntu-font-1.0", r"ubuntu font licen[cs]e"),
    ("ipa", r"ipa font license agreement"),
    ("gust-font", r"gust font (?:source )?license"),
    ("bitstream-vera", r"the font software may be modified, altered, or added to, and in particular the designs of glyphs or characters"),
    ("cc-by", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made"),
    ("cc-by-sa", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("cc", r"by exercising the licensed rights .{0,40}?you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc", r"using creative commons public licenses: ?creative commons public licenses provide a standard set of terms"),
    ("cc-devnations", r"creative commons developing nations license"),
    ("cc-sampling-plus", r"creative commons sampling plus"),
    ("cc-pdm-1.0", r"this work has been identified as being free of known restrictions under copyright law"),
    ("cc0-1.0", r"the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights"),
    ("cc0-1.0", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("unlicense", r"in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest"),
    ("sax-pd", r"no one owns sax: you may use it freely in both commercial and non-commercial applications"),
    ("public-domain-us-government", r"this (?:software|work|file|code) was (?:developed|prepared|produced) (?:at|by|for) .{0,120}?(?:employees?|agenc(?:y|ies)) of the (?:federal|united states|u\.s\.) government"),
    ("public-domain-us-government", r"pursuant to title 17,? section 105 of the united states code"),
    ("nist", r"nist assumes no responsibility whatsoever for its use by other parties"),
    ("odbl-1.0", r"any rights in individual contents of the database are licensed under the database contents license"),
    ("pddl-1.0", r"this .{0,60}?is made available under the public domain dedication and license"),
    ("cdla-permissive-2.0", r"community data license agreement .{0,4}?permissive"),
    ("cdla-sharing-1.0", r"community data license agreement .{0,4}?sharing"),
    ("ogl-uk-3.0", r"contains public sector information licensed under the open government licence"),
    ("ogl-canada", r"contains information licensed under the open government licence .{0,4}?canada"),
    ("dl-de-by-2.0", r"datenlizenz deutschland .{0,4}?namensnennung"),
    ("geonutz", r"geodatennutzungsverordnung"),
    ("geonutz", r"verordnung zur festlegung der nutzungsbestimmungen f[uü]r die bereitstellung von geodaten"),
    ("opl-1.0", r"the open publication works may be reproduced and distributed in whole or in part"),
    ("dsl", r"design science license"),
    ("gutenberg", r"this ebook is for the use of anyone anywhere .{0,120}?at no cost and with almost no restrictions whatsoever"),
    ("gutenberg", r"project gutenberg(?:-tm|™)? license included with this (?:ebook|etext)"),
    # use-restricted, model and source-available terms
    ("busl-1.1", r"change date .{0,200}?change license"),
    ("busl-1.1", r"if your use of the licensed work does not comply with the requirements currently in effect as described in this license"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", r"you may not move, change, disable, or circumvent the license key functionality in the software"),
    ("commons-clause", r"the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software"),
    ("confluent", r"licensee is not granted the right to, and licensee shall not, exercise the license for an excluded purpose"),
    ("timescale", r"timescale license agreement"),
    ("polyform", r"the licensor grants you a copyright license for the software to do everything you might do with the software that would otherwise infringe"),
    ("parity", r"contribute software you develop, operate, or analyze with this software, including changes or additions"),
    ("hippocratic", r"the software may not be used by individuals, corporations, governments, or other groups for systems or activities that .{0,60}?(?:endanger|harm)"),
    ("fsl-1.1", r"functional source license"),
    ("openrail", r"you agree not to use the model or derivatives of the model"),
    ("llama", r"if, on the .{0,60}?release date, the monthly active users of the products or services .{0,120}?is greater than 700 million"),
    ("llama", r"built with (?:meta )?llama"),
    ("gemma", r"gemma is provided under and subject to the gemma terms of use"),
    ("research-only", r"for (?:non-?commercial )?research (?:and educational )?purposes only"),
    ("academic-only", r"free (?:of charge )?for academic (?:and non-?commercial |and research )?use only"),
    ("noncommercial", r"(?:free|permitted|licensed) for (?:personal and )?non-?commercial (?:use|purposes) only"),
    ("proprietary", r"this (?:document|file|software|material) (?:contains|includes) (?:confidential|proprietary) (?:and (?:confidential|proprietary) )?information"),
    ("proprietary", r"by (?:installing|downloading|using|accessing) (?:this|the) software,? you (?:agree|accept|acknowledge)"),
    ("proprietary", r"licensee shall not (?:rent|lease|sublicense|sell|assign|reverse|decompile|disclose|modify)"),
    ("proprietary", r"you may not (?:rent|lease|lend|sublicense|resell) the software"),
    ("proprietary", r"this software is the (?:confidential and )?proprietary information of"),
    ("proprietary", r"use of this (?:product|software) is subject to (?:the )?(?:license|licence) terms"),
    ("proprietary", r"internal use only"),
)
