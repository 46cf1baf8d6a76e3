"""Jobs over whole tables: from landed rows to products, groups, searches and baskets."""
