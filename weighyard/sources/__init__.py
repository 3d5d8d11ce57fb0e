"""Reading and writing tickets, reports and logs."""
