"""Licence scan by sentence rules (native).

A text is cut into sentences after ``. ! ? ; :`` and white space, in two readings: with every
line end as an end of a sentence, for notices of one line, and with line ends as blanks, for
licence texts that are wrapped (there a line without letters or digits ends a sentence, also a
bare comment sign).  Sentences are normalised (lower case, every run of other signs than a-z and
0-9 one blank, so that comment signs vanish) and mapped to the identifiers of known licence
sentences; unknown sentences fall away.  A rule is a sequence of identifiers; a document has the
rule's licence if the sequence occurs without a gap in the identifiers of a reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import table, text_or_empty

# Sentences of well-known licence texts and notices, normalised.
SENTENCES = {
    "mit_name": "released under the mit license",
    "mit_name_2": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not "
                    "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_name": "licensed under the apache license version 2 0",
    "apache_name_2": "licensed under the apache license version 2 0 the license",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_warranty": "unless required by applicable law or agreed to in writing software distributed under the "
                       "license is distributed on an as is basis without warranties or conditions of any kind either "
                       "express or implied",
    "gpl3_name": "this work is licensed under the gnu general public license version 3",
    "gpl3_grant": "this program is free software",
    "gpl3_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as "
                  "published by the free software foundation either version 3 of the license or at your option any "
                  "later version",
    "gpl2_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as "
                  "published by the free software foundation either version 2 of the license or at your option any "
                  "later version",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published "
                 "by the free software foundation",
    "version2": "either version 2 of the license or at your option any later version",
    "version21": "either version 2 1 of the license or at your option any later version",
    "version3": "either version 3 of the license or at your option any later version",
    "library_grant": "this library is free software",
    "lgpl_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
                  "published by the free software foundation",
    "lgpl3_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
                   "published by the free software foundation either version 3 of the license or at your option any "
                   "later version",
    "agpl3_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as "
                   "published by the free software foundation either version 3 of the license or at your option any "
                   "later version",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided "
                 "that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
                  "following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
                  "the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                   "promote products derived from this software without specific prior written permission",
    "bsd_warranty": "this software is provided by the copyright holders and contributors as is and any express or implied "
                    "warranties including but not limited to the implied warranties of merchantability and fitness for a "
                    "particular purpose are disclaimed",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                 "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_warranty": "the software is provided as is and the author disclaims all warranties with regard to this software "
                    "including all implied warranties of merchantability and fitness",
    "mpl_terms": "this source code form is subject to the terms of the mozilla public license v",
    "two_zero": "2 0",
    "unlicense_grant": "this is free and unencumbered software released into the public domain",
    "unlicense_use": "anyone is free to copy modify publish use compile sell or distribute this software either in source "
                     "code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "ccbync_name": "licensed under cc by nc 4 0",
    "ccby_name": "licensed under cc by 4 0",
    "ccbysa_name": "licensed under cc by sa 4 0",
}
# Licence and ordered sentence identifiers.
RULES = [
    ("MIT", ["mit_name"]),
    ("MIT", ["mit_name_2"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("Apache-2.0", ["apache_name"]),
    ("Apache-2.0", ["apache_name_2", "apache_use", "apache_copy"]),
    ("GPL-3.0", ["gpl3_name"]),
    ("GPL-3.0-or-later", ["gpl3_grant", "gpl3_terms"]),
    ("GPL-2.0-or-later", ["gpl3_grant", "gpl2_terms"]),
    ("GPL-2.0-or-later", ["gpl3_grant", "gpl_terms", "version2"]),
    ("GPL-3.0-or-later", ["gpl3_grant", "gpl_terms", "version3"]),
    ("LGPL-2.1-or-later", ["library_grant", "lgpl_terms", "version21"]),
    ("LGPL-3.0-or-later", ["gpl3_grant", "lgpl3_terms"]),
    ("LGPL-3.0-or-later", ["library_grant", "lgpl3_terms"]),
    ("AGPL-3.0-or-later", ["gpl3_grant", "agpl3_terms"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_warranty"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty"]),
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("MPL-2.0", ["mpl_terms", "two_zero"]),
    ("Unlicense", ["unlicense_grant", "unlicense_use"]),
    ("CC-BY-NC-4.0", ["ccbync_name"]),
    ("CC-BY-4.0", ["ccby_name"]),
    ("CC-BY-SA-4.0", ["ccbysa_name"]),
]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences, wrapped, licences) of every document: the identifiers of both readings in
    order, each in angle brackets, and the sorted licences joined by commas.  Null and empty texts
    and texts without known sentences have all empty; repeated rows and a null doc_id are kept;
    equal sentences count each; very long texts are read whole; an empty table gives no rows; other
    columns are ignored.
    """
    low = F.lower(text_or_empty())
    known = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (v, f"<{k}>")])

    def ids(text):
        cut = F.regexp_replace(text, r"([.!?;:])[ \t\r\n]+", "$1\n")
        norm = F.transform(F.split(cut, "\n"), lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
        return F.array_join(F.transform(F.filter(norm, lambda s: s.isin(*SENTENCES.values())), lambda s: F.element_at(known, s)), "")

    # an end of paragraph as a sentence mark of its own, other line ends as blanks
    whole = F.replace(F.regexp_replace(low, r"\n[^a-z0-9]*\n", "! "), F.lit("\n"), F.lit(" "))
    found = F.array_compact(F.array(*[
        F.when(F.contains("sentences", pattern) | F.contains("wrapped", pattern), F.lit(licence))
        for licence, rule in RULES for pattern in [F.lit("".join(f"<{s}>" for s in rule))]]))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ids(low).alias("sentences"), ids(whole).alias("wrapped"))
    return d.withColumn("licences", F.array_join(F.array_sort(F.array_distinct(found)), ","))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ", ".join(f"('{v}', '<{k}>')" for k, v in SENTENCES.items())
    rules = ", ".join(f"('{lic}', '{''.join(f'<{s}>' for s in rule)}')" for lic, rule in RULES)
    return f"""
with k(s, id) as (values {values}), r(licence, rule) as (values {rules}),
t as (select doc_id, 1 as reading, lower(coalesce(text, '')) as x from documents union all
      select doc_id, 2, replace(regexp_replace(lower(coalesce(text, '')), '\\n[^a-z0-9]*\\n', '! ', 'g'), chr(10), ' ') from documents),
c as (select doc_id, reading, string_split(regexp_replace(x, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) as x from t),
l as (select doc_id, reading, unnest(x) as x, unnest(range(len(x))) as n from c),
i as (select doc_id, reading, string_agg(id, '' order by n) as ids
      from l join k on trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) = k.s group by 1, 2),
f as (select doc_id, string_agg(distinct licence, ',' order by licence) as licences
      from i join r on contains(ids, rule) group by doc_id)
select d.doc_id, coalesce(a.ids, '') as sentences, coalesce(b.ids, '') as wrapped, coalesce(licences, '') as licences
from documents d left join i a on a.doc_id = d.doc_id and a.reading = 1 left join i b on b.doc_id = d.doc_id and b.reading = 2
left join f on f.doc_id = d.doc_id
"""


ORACLE_SQL = _oracle()
