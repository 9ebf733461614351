"""Public licence texts and notices, as words: (label, version, words).

Texts have neither capitals nor punctuation, as scans compare words only.
Names of copyright holders and years, which differ in each copy, are left out.
"""

MIT = (
    "permission is hereby granted free of charge to any person "
    "obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge "
    "publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished "
    "to do so subject to the following conditions "
    "the above copyright notice and this permission notice "
    "shall be included in all copies or substantial "
    "portions of the software "
    "the software is provided as is without warranty of any kind "
    "express or implied including but not limited to "
    "the warranties of merchantability fitness for a particular purpose "
    "and noninfringement in no event shall the authors "
    "or copyright holders be liable for any claim damages "
    "or other liability whether in an action of contract tort "
    "or otherwise arising from out of or in connection "
    "with the software or the use or other dealings in the software"
)

BSD_2 = (
    "redistribution and use in source and binary forms "
    "with or without modification are permitted provided that "
    "the following conditions are met "
    "redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
    "this software is provided by the copyright holders and contributors "
    "as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable "
    "for any direct indirect incidental special exemplary "
    "or consequential damages including but not limited to "
    "procurement of substitute goods or services "
    "loss of use data or profits or business interruption "
    "however caused and on any theory of liability "
    "whether in contract strict liability or tort "
    "including negligence or otherwise arising in any way "
    "out of the use of this software "
    "even if advised of the possibility of such damage"
)

BSD_3_CLAUSE = (
    "neither the name of the copyright holder "
    "nor the names of its contributors may be used "
    "to endorse or promote products derived from this software "
    "without specific prior written permission"
)

ISC = (
    "permission to use copy modify and or distribute this software "
    "for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice "
    "appear in all copies "
    "the software is provided as is and the author disclaims all warranties "
    "with regard to this software including all implied warranties "
    "of merchantability and fitness in no event shall the author be liable "
    "for any special direct indirect or consequential damages "
    "or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action "
    "arising out of or in connection with the use "
    "or performance of this software"
)

ZLIB = (
    "this software is provided as is without any express or implied warranty "
    "in no event will the authors be held liable for any damages "
    "arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose "
    "including commercial applications and to alter it and redistribute it freely "
    "subject to the following restrictions "
    "the origin of this software must not be misrepresented "
    "you must not claim that you wrote the original software "
    "if you use this software in a product an acknowledgment "
    "in the product documentation would be appreciated but is not required "
    "altered source versions must be plainly marked as such "
    "and must not be misrepresented as being the original software "
    "this notice may not be removed or altered from any source distribution"
)

BOOST = (
    "permission is hereby granted free of charge to any person or organization "
    "obtaining a copy of the software and accompanying documentation "
    "covered by this license the software to use reproduce display distribute "
    "execute and transmit the software and to prepare derivative works "
    "of the software and to permit third parties to whom the software is furnished "
    "to do so all subject to the following "
    "the copyright notices in the software and this entire statement "
    "including the above license grant this restriction "
    "and the following disclaimer must be included in all copies of the software "
    "in whole or in part and all derivative works of the software "
    "unless such copies or derivative works are solely in the form "
    "of machine executable object code generated by a source language processor"
)

UNLICENSE = (
    "this is free and unencumbered software released into the public domain "
    "anyone is free to copy modify publish use compile sell or distribute "
    "this software either in source code form or as a compiled binary "
    "for any purpose commercial or non commercial and by any means "
    "in jurisdictions that recognize copyright laws the author or authors "
    "of this software dedicate any and all copyright interest "
    "in the software to the public domain "
    "we make this dedication for the benefit of the public at large "
    "and to the detriment of our heirs and successors "
    "we intend this dedication to be an overt act of relinquishment "
    "in perpetuity of all present and future rights "
    "to this software under copyright law"
)

APACHE_NOTICE = (
    "licensed under the apache license version 2 0 the license "
    "you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software "
    "distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions "
    "and limitations under the license"
)

APACHE_GRANT = (
    "grant of copyright license subject to the terms and conditions "
    "of this license each contributor hereby grants to you a perpetual "
    "worldwide non exclusive no charge royalty free irrevocable "
    "copyright license to reproduce prepare derivative works of "
    "publicly display publicly perform sublicense and distribute the work "
    "and such derivative works in source or object form"
)

GPL_NOTICE = (
    "this program is free software you can redistribute it and or modify "
    "it under the terms of the gnu general public license "
    "as published by the free software foundation"
)
_LATER = " of the license or at your option any later version"
_WARRANTY = (
    " this program is distributed in the hope that it will be useful "
    "but without any warranty without even the implied warranty "
    "of merchantability or fitness for a particular purpose "
    "see the gnu general public license for more details"
)
LGPL_NOTICE = (
    "this library is free software you can redistribute it and or modify "
    "it under the terms of the gnu lesser general public license "
    "as published by the free software foundation"
)
AGPL_NOTICE = (
    "this program is free software you can redistribute it and or modify "
    "it under the terms of the gnu affero general public license "
    "as published by the free software foundation"
)

#: (label, version, words) of whole texts and of their usual notices.
TEXTS = [
    ("mit", "", MIT[: MIT.index(" including")]),
    ("mit", "", MIT),
    ("apache-2", "2.0", APACHE_NOTICE),
    ("apache-2", "2.0", APACHE_NOTICE[: APACHE_NOTICE.index(" you may obtain")]),
    ("apache-2", "2.0", APACHE_GRANT),
    ("bsd", "2-clause", BSD_2),
    ("bsd", "", BSD_2[: BSD_2.index(" redistributions")]),
    ("bsd-3", "3-clause", BSD_3_CLAUSE),
    ("isc", "", ISC),
    ("isc", "", ISC[: ISC.index(" provided")]),
    ("zlib", "", ZLIB),
    ("bsl-1", "1.0", BOOST),
    ("bsl-1", "1.0", "boost software license version 1 0"),
    ("unlicense", "", UNLICENSE),
    ("unlicense", "", UNLICENSE[: UNLICENSE.index(" anyone")]),
    ("gpl", "", "gnu general public license"),
    ("lgpl", "", "gnu lesser general public license"),
    ("agpl", "", "gnu affero general public license"),
    ("gpl", "", GPL_NOTICE),
    ("gpl", "2", GPL_NOTICE + " either version 2" + _LATER + _WARRANTY),
    ("gpl", "2", "gnu general public license version 2"),
    ("gpl", "3", "gnu general public license version 3"),
    ("gpl", "3", GPL_NOTICE + " either version 3" + _LATER),
    ("lgpl", "2.1", LGPL_NOTICE + " either version 2 1" + _LATER),
    ("agpl", "3", AGPL_NOTICE + " either version 3" + _LATER),
    ("mpl-2", "2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "", "cc by sa"),
    ("cc-by-nd", "", "cc by nd"),
    ("cc0", "1.0", "cc0 1 0 universal"),
    ("cc0", "1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("epl", "", "eclipse public license"),
    ("wtfpl", "2", "do what the fuck you want to public license"),
    ("all-rights-reserved", "", "all rights reserved"),
]
