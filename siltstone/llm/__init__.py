"""Operators for preparing training text. Nothing outside this subpackage imports it.

Conventions shared by all ten operators:

* Input is a DataFrame with an integer ``doc_id`` and a string ``text``; every
  other column is ignored, whatever its name, and never collides with an
  internal one because the two needed columns are selected first.
* A row whose ``doc_id`` is null has no identity: listings leave it out,
  pipeline stages pass it on unchanged.  A null ``text`` counts as empty.
* Rows repeating one ``doc_id`` with one text are the same document.
* Texts are read whole, as UTF-8 bytes in Arrow buffers, in blocks of whole
  documents; the kernels are numpy and never loop over characters in Python.
"""
