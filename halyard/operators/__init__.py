"""Search, fusion, quantisation and collection maintenance."""
