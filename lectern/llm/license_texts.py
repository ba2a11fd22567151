"""Wording of licenses and of license notices, in template markup.

``[[...]]`` may be left out, ``{n}`` stands for any n words at most (a name, a version).  Case and
punctuation don't count.
"""

# fixed values: public license texts and notices
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {6} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] [[a]] redistributions of source code must retain the [[above]] copyright notice this list of conditions and the following disclaimer "
    "[[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_WARRANTY = (
    "this software is provided by the {8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the {8} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU = (
    "{12} is free software you can redistribute it and or modify it under the terms of the gnu {2} general public license as published by the free software foundation either version {2} of the license or [[at your option]] any later version "
    "{12} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {2} general public license for more details"
)

#: label: templates
TEMPLATES = {
    "gpl-notice": ["[[this work is]] [[this program is]] licensed under [[the terms of]] the gnu general public license [[version {2}]]", "under the terms of the gnu general public license as published by the free software foundation [[either]] [[version {2}]]"],
    "lgpl-notice": ["licensed under [[the terms of]] the gnu lesser general public license [[version {2}]]", "under the terms of the gnu lesser general public license as published by the free software foundation [[either]] [[version {2}]]"],
    "agpl-notice": ["licensed under [[the terms of]] the gnu affero general public license [[version {2}]]", "under the terms of the gnu affero general public license as published by the free software foundation [[either]] [[version {2}]]"],
    "gnu-header": ["this " + _GNU],
    "apache-notice": ["licensed under the apache license version {2}", "licensed under the apache license [[version {2}]] the license you may not use this file except in compliance with the license"],
    "apache-header": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[{6}]] "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license"
    ],
    "cc-by-notice": ["licensed under [[a]] cc by [[nc]] [[sa]] [[nd]] {2}", "licensed under [[a]] [[the]] creative commons attribution [[noncommercial]] [[sharealike]] {2} [[international]] license"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _AS_IS
    ],
    "isc-text": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the {4} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the {4} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "bsd-notice": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-2-text": [_BSD_CONDITIONS + _BSD_WARRANTY],
    "bsd-3-text": [_BSD_CONDITIONS + "[[3]] [[c]] neither the name of {12} nor the names of {6} may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_WARRANTY],
    "zlib-text": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[[3]] this notice may not be removed or altered from any source distribution"
    ],
    "boost-text": ["distributed under the boost software license version 1 0 [[see accompanying file {2} or copy at {6}]]"],
    "unlicense-text": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "cc0-notice": ["to the extent possible under law {8} has [[dedicated all copyright and related and neighboring rights to this software to the public domain worldwide]] [[waived all copyright and related or neighboring rights to {4}]]"],
    "mpl-notice": ["this source code form is subject to the terms of the mozilla public license v {2}"],
    "mpl-header": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {6}"],
    "rights-reserved": ["all rights reserved"],
    "copyright-notice": ["copyright [[c]] {1} [[by]] {4} all rights reserved"],
}
