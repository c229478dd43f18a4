"""Licence scans: all licences of a text, SPDX lines, wrapped notices."""

import pytest

from weftline.llm import licenses

GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies. The software is provided as is."
BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice. "
BSD3 = BSD2 + "Neither the name of X nor of its contributors may be used to endorse or promote products. "


@pytest.mark.parametrize(
    "text, want",
    [
        (MIT + " " + GPL3, {"MIT", "GPL-3.0"}),
        (GPL3, {"GPL-3.0"}),
        ("\n".join(GPL3.split(" ")), {"GPL-3.0"}),
        (GPL3.replace("version 3", "version 2"), {"GPL-2.0"}),
        (BSD3, {"BSD-3-Clause"}),
        (BSD3 + BSD2, {"BSD-3-Clause", "BSD-2-Clause"}),
        ("// SPDX-License-Identifier: MIT", {"MIT"}),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later WITH Classpath-exception-2.0\nx", {"MIT", "Apache-2.0", "GPL-2.0"}),
        ("SPDX-License-Identifier: (MIT OR ISC) AND Zlib", {"MIT", "ISC", "Zlib"}),
        ("SPDX-License-Identifier: BSD-3-Clause\nCopyright 2020 A. All rights reserved.", {"BSD-3-Clause"}),
        ("SPDX-License-Identifier: ISC */", {"ISC"}),
        ("This is in the public-domain now", {"Public-Domain"}),
        ("CC BY-SA and CC BY", {"CC-BY-SA", "CC-BY"}),
        ("nothing here", set()),
    ],
)
def test_all_licences_are_named(text, want):
    assert {x for x, _ in licenses.licenses_of([x[0] for x in licenses.identifiers(text)])} == want


def test_scan_gives_all_of_them(spark):
    r = licenses.scan_licenses(spark.createDataFrame([(1, MIT + " " + GPL3), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(x.license, x.kind) for x in r[0].licenses] == [("MIT", "full"), ("GPL-3.0", "full")] and r[0].license == "MIT" and r[1].licenses == []
