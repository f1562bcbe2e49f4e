#: Nulls, empty and blank texts, a very long one, repeated rows, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word " * 40_000), (5, "one two three four five"), (5, "one two three four five"),
    (None, "no id at all here"), (None, None), (6, "é́ \U0001f600 x\x0b\x1cy\n\n z"), (7, "x" * 5000),
]
