"""Where rows come from: typed columns, vector stores, metadata stores over DataFrames or files."""
