"""DataFrame to DataFrame operators; columns are parameters, masks are columns, invalid is null."""
