"""Sources: delimited text of any shape, workbooks, statistics files, clipboard text."""
