"""Analytics over tickets, hours and days."""
