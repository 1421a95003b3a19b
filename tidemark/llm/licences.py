"""Wordings of well-known licences, from which the scanner learns and against which it compares.

Each family has the notices by which works usually name it and sentences of its
text.  All are fixed values: public phrases, as their publishers word them.
"""

TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL-3.0 license.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
        "Licensed under the Boost Software License 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "Content is available under a Creative Commons Attribution-NonCommercial license.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-nc-sa": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc-sa/4.0/",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ],
    "cc-by-nd": [
        "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nd/4.0/",
        "Licensed under CC BY-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, under CC0 1.0 Universal, the public domain dedication.",
        "This work is dedicated to the public domain under CC0 1.0.",
        "To view a copy of the CC0 legal code, visit http://creativecommons.org/publicdomain/zero/1.0/",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
        "Licensed under the Eclipse Public License.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
        "This work is licensed under the GNU Lesser General Public License.",
        "Licensed under the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License 2.0.",
        "Released under the MPL.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the publisher. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This document contains proprietary and confidential information. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This material may not be published, broadcast, rewritten or redistributed.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "For more information, please refer to https://unlicense.org",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
}

#: Licence wording that names no family; the classifier learns it as "unknown".
GENERIC = [
    "See the LICENSE file for details.",
    "This software is licensed under the terms of the license agreement that comes with it.",
    "Use of this material is subject to the license terms at the end of this document.",
    "You may copy and distribute this work under the terms of the following license.",
    "Permission is granted to copy, distribute and modify this document provided that this notice is kept.",
    "Licensed under an open source license; see the accompanying documentation.",
    "By downloading this software you agree to the terms of this license.",
    "This license grants you a non-exclusive right to use the data set.",
    "The copyright holder grants permission to use this work under the conditions below.",
    "Released under a custom license, version 1.0.",
    "This data is made available under the terms of the open data licence.",
    "Distributed under the terms of the public licence of the project.",
    "SPDX-License-Identifier: LicenseRef-Custom",
]

#: Sentences that use the words of licences without being one.
DECOYS = [
    "The driver's license was issued by the state and is valid for four years.",
    "She works for a licensed electrician and public school teacher.",
    "Copyright law protects original works of authorship for a limited time.",
    "The software version was released under heavy time pressure last spring.",
    "All rights to the land were granted free of charge to the city.",
    "The general public was asked to view a copy of the plan and its conditions.",
    "He obtained permission to use the files of this department without restriction.",
    "This work is the best of the author, and the version at the end is new.",
    "Version 2.0 of the program adds binary forms and a source list.",
    "You may view the notice at the above address along with a copy of this list.",
    "The court held that the copyright notice on the label was required by law.",
    "Students at MIT and Berkeley study the distribution of software patents.",
    "The Apache helicopter and the Eclipse sports car share a version of the engine.",
    "Mozilla and the Free Software Foundation published their yearly reports.",
    "The public domain holds the works of authors who died long ago.",
    "All seats are reserved for the rights holders of the first tournament.",
    "A warranty of two years covers all parts of the machine, either new or used.",
    "The bar lost its license to sell liquor without a hearing.",
    "The author was granted the rights to the film for a fee.",
    "The terms of the agreement between the unions and the state were published on Friday.",
    "Permission slips must be signed by a parent before the trip.",
    "The creative commons room on the second floor is open to the public at all times.",
    "He gave attribution for the painting to a student of the master.",
    "The conditions on the road were worse than the notice implied.",
    "A copy of the report was distributed to any person who asked for one.",
    "The foundation was laid in the spring, and the source of the river is near.",
]
