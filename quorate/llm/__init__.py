"""Training-data operators: archives, classifiers, packing, de-duplication, search and tokenising.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface;
``registry`` derives the ``opN_*`` queries from them.
"""
