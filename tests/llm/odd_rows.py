"""Odd documents."""

#: Names that operators use inside, as columns of the input.
CLASHING = "id norm digest run place key fp component node label size n kept keep_id group_size copies block words found base q score row leaf line mixed_id MIXED_COPIES mixed_copy kept_id kept_place kept_key audit part shard".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."),
    (2, "The quick  brown fox\tjumps over the lazy dog."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "x"),
    (7, "ab " * 30_000),
    (8, "mail me a.b@c.de or a.b@c.de_f@g.hi, +49 (30) 1234-5678, 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 4111111111111112"),
    (8, "The quick brown fox jumps over the lazy dog."),
    (8, "The quick brown fox jumps over the lazy dog."),
    (None, "x"),
    (None, "no id"),
    (9, "Ünïcode ß 😀 don't it's\u00a0nbsp  two   three\r\nnext \n line <|endoftext|> 123 4567 $%&"),
    (10, "9" * 5000 + "@" * 50 + "+" * 50),
]
