"""Operations on training texts: tokens, rules, duplicates, languages, models, chats.

Nothing outside this subpackage imports it. The scoring records of the library (applications,
credit records, scores) hold numbers and short codes but no prose, pages or conversations, so the
operators here are general: they take any table with a text column and name their columns by
parameter. Each one says in its docstring what it does with nulls, empty and very long texts, repeated
rows, empty tables and further columns.
"""
