"""DataFrame operators: joins, aggregations and ordered scans."""
