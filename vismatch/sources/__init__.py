"""Reading image catalogues and tables; writing tables, metadata and results."""
