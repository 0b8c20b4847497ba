"""Plan builders and the queries of the driver contract."""
