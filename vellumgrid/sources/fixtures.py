"""Small inputs of our own, read beside the corpus so that rules which the corpus never breaks are exercised too."""

BLOCKS = [
    # repetition
    (-1, 0, "Bu bu cümlede bir bir kelime kelime iki kez yazılmıştır."),
    (-1, 1, "Davalı şirket sözleşmenin beşinci maddesine aykırı davranmıştır ve bu durum açıktır."),
    (-1, 2, "davalı  ŞİRKET sözleşmenin beşinci maddesine aykırı davranmıştır ve bu durum açıktır."),
    (-1, 3, "Davalı şirket sözleşmenin altıncı maddesine aykırı davranmıştır ve bu durum çok açıktır."),
    (-1, 4, "Çok çok uzun 12 12 sayılar ve a a harfi."),
    # punctuation
    (-2, 0, "Bu cümle iki nokta ile bitiyor.. Sonra devam,, eder!! ama bu... serbest?! ve Y.. gizlidir;."),
    (-2, 1, "Boşluk var , burada da ; ve orada : ama\tburada yok ."),
    (-2, 2, "Virgülden sonra,boşluk yok;burada da yok ama 1.250,50 sayıdır ve www.ornek.com adrestir."),
    (-2, 3, "İki  boşluk   fazla  var. "),
    (-2, 4, "Ankara' da ve Ek-3' te durum budur; Ali 'nin evi."),
    (-2, 5, "Parantez ( içi boşluk ) ve [ köşeli] ile (düzgün) metin."),
    (-2, 6, "Açık (parantez kapanmadı ve [ köşeli de."),
    (-2, 7, "Kapanan) parantez ve “açık tırnak kaldı."),
    (-2, 8, "Tek \"düz tırnak kaldı burada"),
    # invisible characters
    (-3, 0, "Görünmez\u200bkarakter ve\u00adyumuşak\ufeffişaret ile \ufffd bozuk."),
    (-3, 1, "Tire - ve kısa – ile uzun — karışık."),
    (-3, 2, "Sekme\tmetin içinde\t\tvar."),
    # drafts
    (-4, 0, "Sayın [İSİM] tarafından ........ tarihinde ____ imzalanan XXXX sayılı belge."),
    (-4, 1, "Bu nedenle ve"),
    (-4, 2, "1."),
    (-4, 3, "2. Dolu madde"),
    # markers and sequences
    (-5, 0, "GİRİŞ"),
    (-5, 1, "1. İlk madde burada yer alır"),
    (-5, 2, "2. İkinci madde burada yer alır"),
    (-5, 3, "a) alt bent"),
    (-5, 4, "b) alt bent"),
    (-5, 5, "d) alt bent"),
    (-5, 6, "4. Dördüncü madde"),
    (-5, 7, "4. Yine dördüncü"),
    (-5, 8, "3. Geri dönüş"),
    (-5, 9, "SONUÇ VE İSTEM"),
    (-5, 10, "1. Yeniden başlar"),
    (-5, 11, "3. Atlar"),
    (-6, 0, "I. Birinci bölüm"),
    (-6, 1, "II. İkinci bölüm"),
    (-6, 2, "IV. Dördüncü bölüm"),
    (-6, 3, "(a) ayraçlı bent"),
    (-6, 4, "(c) ayraçlı bent"),
    (-6, 5, "A) harf"),
    (-6, 6, "B) harf"),
    (-6, 7, "C) harf"),
    (-6, 8, "Ç) harf"),
    (-6, 9, "E) harf"),
    (-6, 10, "1990 yılında yapılan işlem"),
    (-6, 11, "5 - tireli madde"),
    # attachments and references
    (-7, 0, "Ek-1: Vekâletname örneği"),
    (-7, 1, "Ek-2: Sözleşme örneği"),
    (-7, 2, "Ek-4: Fatura örneği"),
    (-7, 3, "Dilekçede Ek-1 ve Ek-3 ile Ek-7 sunulmuştur."),
    (-7, 4, "Yukarıda 9. maddede açıklandığı gibi ve ek 5 de bellidir."),
    (-7, 5, "1. Madde burada ve 1. maddeye uygundur."),
    # consistency
    (-8, 0, "Tarih 12.03.2021 ve 5 Mart 2021 ile 2021-03-07 aynı yazılmalıdır."),
    (-8, 1, "Tutar 1.250,00 TL ile 300 Türk Lirası ve 45 ₺ farklıdır."),
    (-8, 2, "TBK m. 12 ile TBK md. 12 ve TBK 12. madde aynıdır; HMK m. 7 tektir."),
    (-8, 3, "Müvekkil şirket müvekkil adına muvekkil olarak hareket eder; kâğıt ve kağıt."),
    (-8, 4, "Toplam 1.250,00 (bin iki yüz elli) TL ve 300,00 (iki yüz) TL ödenir."),
    # orthography and dictionary
    (-9, 0, "Herşey yolunda ve birçok şeyi hiçbirşey değiştirmez; pekçok kişi herşeyi bilir."),
    (-9, 1, "Mahkemenin karari kesindir ve kararı onanmıştır; Karari."),
    (-9, 2, "Muvekkilin beyanı ve kararinin gerekçesi açıktır."),
    (-10, 0, "Temiz bir cümle yazdık. Hiçbir kusuru yoktur."),
    (-10, 1, ""),
    (-10, 2, "   "),
]

TOKENS = [
    "IŞIK", "İstanbul", "ılık", "istanbul’da", "Ek-3'te", "kâğıt", "MÜVEKKİL", "muvekkil", "Çöğüşİ", "straße", "café", "A.Ş.", "1.250,00 TL", "C:\\yol\\dosya.docx", "/ev/belge.UDF",
    "e-posta@ornek.com", "“tırnak” — tire", "  boş   luk  ", "", "x < y & z > \"q\"", "*kalın* _eğik_ [bağ](u)", "12.03.2021", "http://a.b/c?d=e", "IV", "xix", "MCMXCIV", "IIII", "abc\u200bdef", "Rapor (son) 2024.pdf", "CON", "aux.txt",
]

NAMES = ["Dilekçe.docx", "belge.UDF", "tarama.pdf", "foto.JPG", "arşiv.tar.gz", "adsız", "tablo.xlsx", "eski.doc", "sunum.PPTX", "not.txt", "resim.heic", ".gizli", "a.b.docx"]

CONTENTS = ["504b0304140000000800", "255044462d312e370a", "ffd8ffe000104a464946", "89504e470d0a1a0a0000", "49492a0008000000", "4d4d002a00000008", "d0cf11e0a1b11ae1", "00000018667479706865", "3c3f786d6c20766572", "efbbbf41", ""]
