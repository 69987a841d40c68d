"""Licence notices as data: passages as they stand in files, and phrases that must be there."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    label: str
    mandatory: tuple[str, ...]
    text: str


# Notices in words, lower-cased, without punctuation. One of the mandatory phrases must stand in the file.
NOTICES = (
    Template("gpl", ("gnu general public license",),
             "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
             "as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("gpl", ("gnu general public license",),
             "this work is licensed under the gnu general public license version 3"),
    Template("lgpl", ("gnu lesser general public license", "gnu library general public license"),
             "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
             "as published by the free software foundation"),
    Template("agpl", ("gnu affero general public license",),
             "you can redistribute it and or modify it under the terms of the gnu affero general public license "
             "as published by the free software foundation"),
    Template("apache", ("apache license",),
             "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
             "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to "
             "in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    Template("apache", ("apache license",), "licensed under the apache license version 2 0"),
    Template("mit", ("mit license",), "released under the mit license"),
    Template("mit", ("permission is hereby granted free of charge", "the software is provided as is without warranty of any kind"),
             "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
             "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
             "distribute sublicense and or sell copies of the software"),
    Template("bsd", ("redistribution and use in source and binary forms",),
             "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
             "conditions are met"),
    Template("bsd", ("redistributions of source code must retain the above copyright notice",),
             "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
             "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
             "in the documentation and or other materials provided with the distribution"),
    Template("bsd-3", ("may be used to endorse or promote products derived from this software",),
             "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission"),
    Template("isc", ("permission to use copy modify and or distribute this software", "permission to use copy modify and distribute this software"),
             "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
             "that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", ("mozilla public license",),
             "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("mpl", ("mozilla public license",),
             "the contents of this file are subject to the mozilla public license version 1 1"),
    Template("epl", ("eclipse public license",),
             "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    Template("epl", ("eclipse public license",),
             "eclipse public license v1 0 which accompanies this distribution and is available at"),
    Template("cddl", ("common development and distribution license",),
             "the contents of this file are subject to the terms of the common development and distribution license"),
    Template("artistic", ("artistic license", "same terms as perl"),
             "this library is free software you can redistribute it and or modify it under the same terms as perl itself"),
    Template("artistic", ("artistic license",), "you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    Template("zlib", ("permission is granted to anyone to use this software for any purpose",),
             "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
             "redistribute it freely subject to the following restrictions"),
    Template("boost", ("boost software license", "any person or organization obtaining a copy of the software"),
             "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
             "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to "
             "prepare derivative works of the software"),
    Template("boost", ("boost software license",), "distributed under the boost software license version 1 0"),
    Template("unlicense", ("released into the public domain",),
             "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
             "or distribute this software"),
    Template("cc0", ("waived all copyright and related or neighboring rights",),
             "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("eupl", ("european union public licence", "under the eupl"),
             "licensed under the eupl version 1 2 you may not use this work except in compliance with the licence"),
    Template("wtfpl", ("do what the fuck you want to public license",), "do what the fuck you want to public license"),
    Template("postgresql", ("for any purpose without fee and without a written agreement",),
             "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a "
             "written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two "
             "paragraphs appear in all copies"),
    Template("ofl", ("sil open font license",), "this font software is licensed under the sil open font license version 1 1"),
    Template("gfdl", ("gnu free documentation license",),
             "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    Template("cc-by", ("cc by", "creative commons attribution"), "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"),
             "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"),
             "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-nd", ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"),
             "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    Template("cc-by-nc", ("cc by nc",), "licensed under cc by nc 4 0"),
    Template("cc-by-sa", ("cc by sa",), "licensed under cc by sa 4 0"),
    Template("cc-by-nd", ("cc by nd",), "licensed under cc by nd 4 0"),
)

# How an SPDX identifier begins, in words, and its label.
SPDX = {
    "agpl 3 0": "agpl",
    "apache 2 0": "apache",
    "artistic 2 0": "artistic",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd-3",
    "bsl 1 0": "boost",
    "cc by 4 0": "cc-by",
    "cc by nc 4 0": "cc-by-nc",
    "cc by nd 4 0": "cc-by-nd",
    "cc by sa 4 0": "cc-by-sa",
    "cc0 1 0": "cc0",
    "cddl 1 0": "cddl",
    "epl 1 0": "epl",
    "epl 2 0": "epl",
    "eupl 1 2": "eupl",
    "gfdl 1 3": "gfdl",
    "gpl 2 0": "gpl",
    "gpl 3 0": "gpl",
    "isc": "isc",
    "lgpl 2 1": "lgpl",
    "lgpl 3 0": "lgpl",
    "mit": "mit",
    "mpl 1 1": "mpl",
    "mpl 2 0": "mpl",
    "ofl 1 1": "ofl",
    "postgresql": "postgresql",
    "unlicense": "unlicense",
    "wtfpl": "wtfpl",
    "zlib": "zlib",
}
TAG = "spdx license identifier"

TEMPLATES = NOTICES + tuple(Template(label, (f"{TAG} {name}",), f"{TAG} {name}") for name, label in SPDX.items())
