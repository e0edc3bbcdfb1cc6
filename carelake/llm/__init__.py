"""Training-data operators: mixing, language ID, decontamination, scoring, ...

Each module holds one operator with its own interface; ``queries`` registers the
``opN_<name>`` queries. Nothing else in the library imports this package.
"""
