"""From a specification to a lazy DataFrame: filters, relations, aggregates, order and paging."""
