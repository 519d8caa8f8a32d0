"""Functions of columns: vector metrics and datetimes."""
