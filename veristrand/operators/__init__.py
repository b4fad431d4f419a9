"""DataFrame to DataFrame operators of the evidence engine.

Frames name a document by the column ``paper``; an operator reads the columns its docstring
names and ignores others unless it says that they are kept.
"""
