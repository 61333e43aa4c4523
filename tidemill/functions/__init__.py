"""Column -> Column functions; nothing in here touches a DataFrame."""
