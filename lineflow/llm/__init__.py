"""Operations of a training-data pipeline: cleaning, scoring, deduplication, tokens, packing.

Nothing else in the library imports this subpackage. Every operator reads only the columns it
is told to read, so further columns, whatever their names, do not disturb it.
"""
